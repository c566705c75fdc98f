"""Toxicity by a lexicon whose misspellings are caught too, weighed by context.

Lexicon: words, and beginnings of words (of one or of several words of a text), whose share of toxic documents is
above that of all documents by more than chance gives, counted by a distributed
aggregation over at most ``TRAIN_DOCS`` labelled rows (in the order of a hash; a
fixed bound on what the classifier is fitted on).  Only hits that are not quoted
count; equal texts count once, and so do toxic documents whose hits have the
same neighbours, as near copies have.  The test is Chernoff's bound on the binomial
tail, at a level of one over the number of terms tested, so that less than one
term is expected by chance, however rare or many the terms are; and most of the
documents with such hits are toxic.

Matching: the lexicon is a trie, and the Levenshtein automaton of its terms
(one edit from five letters on, two from nine; an exchange of neighbours is one
edit; the first letter must agree but for its accent) is intersected with it.  Edits count code
points: texts and terms are folded to one byte for each.  Determinising the intersection gives one table of
states; all words of a slice of text run through it side by side, one byte a
step, and most drop out after two or three.

Context: a hit counts as quotation if the three words before and the three
after it both hold a quotation mark, or a reporting word stands among the four
words before it.  Each (term, misspelled, quoted, many) has a weight, many telling
whether different words of the text match the term: the share of
toxic documents among the training documents with such a hit, smoothed.  A
document's score joins its terms, each once at its largest weight, and the
share of toxic documents among those without a hit: its complement is the
product of theirs, where a weight counts by what it has above that share.

Defined results: null and empty texts have no hit; rows with equal doc_id and
text get equal scores; a null doc_id is not held out; without any label the
lexicon is empty and all scores are 0; an empty table gives an empty result;
other columns are ignored, and no label, language, source or doc_id enters a
score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import hash_sample, stored

TRAIN_DOCS = 16_384
THRESHOLD = 0.3
#: Weight of a misspelling of which training saw none, and the start for the others.
UNSEEN_MISSPELLED = 0.5
#: Letters of the beginnings that are terms, and of those that make terms a family.
STEMS = (3, 4, 5, 6, 7, 8)
FAMILY = 3
WINDOW = 3
#: Words that report what others said, in the four languages.
REPORTING = frozenset(
    "said wrote writes quoted quote called word term dit écrit cite mot terme sagte schrieb zitiert wort begriff dijo escribió cita palabra término".encode("latin-1").split()
)

#: Quotation marks.
QUOTES = [0x22, 0xAB, 0xBB, 0x201C, 0x201D, 0x201E]


def letters() -> np.ndarray:
    """One byte for each code point of the first plane: lower case; digits as the letters they stand for; 32 for what breaks words.

    Letters beyond ASCII keep seven bits, which tells those of Latin-1, or of one
    alphabet, apart; letters of different scripts can look alike.
    """
    of = np.full(0x10000, 32, np.uint8)
    for c in range(0x80, 0x10000):
        if 0xD800 <= c < 0xE000 or not unicodedata.category(chr(c)).startswith("L"):
            continue
        of[c] = 128 + ord(chr(c).lower()[0]) % 128
    of[97:123] = of[65:91] = np.arange(97, 123)
    of[48:58] = list(b"oizeasbtbg")
    return of


LETTERS = letters()
#: The letters without their accents.
BARE = np.array([ord(unicodedata.normalize("NFD", chr(b))[0]) for b in range(256)])


def folded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte per code point of the texts, their bounds, and where quotation marks stand; combining marks are left out."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    first, second, third = padded[lead], padded[lead + 1] & 0x3F, padded[lead + 2] & 0x3F
    code = np.where(first < 0x80, first, np.where(first < 0xE0, (first & 0x1F) << 6 | second, np.where(first < 0xF0, (first & 0x0F) << 12 | second << 6 | third, 0xFFFF)))
    keep = (code < 0x300) | (code > 0x36F)
    places = np.zeros(len(data) + 1, np.int64)
    places[lead[keep] + 1] = 1
    np.cumsum(places, out=places)
    code = code[keep]
    return LETTERS[code], places[bounds], np.isin(code, QUOTES)


_CODES, _WORD = K.byte_codes(61), K.Roller(62)


def edits_allowed(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


def build_trie(terms: list[str]) -> tuple[list[dict[int, int]], list[tuple[int, int, bool] | None], list[int]]:
    """Children of each node, the term that ends there (index, edits allowed, open-ended), and the most edits below.

    A term that ends in ``*`` matches every word that begins with it.
    """
    children: list[dict[int, int]] = [{}]
    ends: list[tuple[int, int, bool] | None] = [None]
    most = [0]
    for k, term in enumerate(terms):
        stem, at = term.rstrip("*"), 0
        allowed = edits_allowed(stem)
        for byte in stem.encode("latin-1"):
            most[at] = max(most[at], allowed)
            if byte not in children[at]:
                children[at][byte] = len(children)
                children.append({})
                ends.append(None)
                most.append(0)
            at = children[at][byte]
        most[at] = max(most[at], allowed)
        ends[at] = (k, allowed, term.endswith("*"))
    return children, ends, most


@dataclass
class Automaton:
    """A table of states by byte class; state 0 is dead, state 1 the start."""

    classes: np.ndarray
    table: np.ndarray
    term: np.ndarray
    edits: np.ndarray

    def match(self, texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that match, with term and number of edits."""
        length = texts.end - texts.start
        state = np.ones(len(length), np.int32)
        alive, step = np.arange(len(length)), 0
        coded = self.classes[texts.data]
        while len(alive):
            now = alive[length[alive] > step]
            state[now] = self.table[state[now], coded[texts.start[now] + step]]
            alive, step = now[state[now] != 0], step + 1
        hit = np.flatnonzero(self.term[state] >= 0)
        return hit, self.term[state[hit]], self.edits[state[hit]]


def intersect(terms: list[str]) -> Automaton:
    """The determinised intersection of the terms' trie with their Levenshtein automata."""
    children, ends, most = build_trie(terms)
    used = {b for c in children for b in c}
    used = sorted(used | {b for b in range(256) if any(BARE[b] == BARE[x] for x in children[0])})
    classes = np.zeros(256, np.int16)
    classes[used] = np.arange(1, len(used) + 1)

    def closed(states: dict) -> frozenset:
        """With the nodes reached by leaving letters out.

        Negative nodes are finished open-ended terms; a pair is a node that waits for
        the second letter of an exchange.
        """
        todo = list(states.items())
        while todo:
            node, e = todo.pop()
            if states.get(node, 99) < e or isinstance(node, tuple) or node < 0:
                continue
            end = ends[node]
            if end is not None and end[2] and e <= end[1] and states.get(-1 - end[0], 99) > e:
                states[-1 - end[0]] = e
            if node == 0:
                continue  # the first letter must be there
            for child in children[node].values():
                if e < most[child] and states.get(child, 99) > e + 1:
                    states[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(states.items())

    def step(states: frozenset, byte: int | None) -> frozenset:
        out: dict = {}

        def put(node: int | tuple[int, int], e: int) -> None:
            if out.get(node, 99) > e:
                out[node] = e

        for node, e in states:
            if isinstance(node, tuple):
                if node[1] == byte:
                    put(node[0], e)
                continue
            if node < 0:
                put(node, e)
                continue
            if byte in children[node]:
                put(children[node][byte], e)
            elif node == 0 and byte is not None:  # the first letter may differ by its accent
                for letter, child in children[0].items():
                    if BARE[letter] == BARE[byte] and e < most[child]:
                        put(child, e + 1)
            if node and e < most[node]:
                put(node, e + 1)
                for letter, child in children[node].items():
                    if e < most[child]:
                        put(child, e + 1)
                    after = children[child].get(byte)
                    if after is not None and e < most[after]:
                        put((after, letter), e + 1)
        return closed(out)

    def best(states: frozenset) -> tuple[int, int]:
        nodes = [(node, e) for node, e in states if not isinstance(node, tuple)]
        found = [(e, -1 - node) for node, e in nodes if node < 0]
        found += [(e, ends[node][0]) for node, e in nodes if node >= 0 and ends[node] is not None and e <= ends[node][1]]
        return min(found, default=(-1, -1))

    start = closed({0: 0})
    numbers, order = {frozenset(): 0, start: 1}, [frozenset(), start]
    rows: list[list[int]] = []
    for states in order:
        told: set[int] = set()  # all other bytes lead where no letter of the terms does
        for node, e in states:
            if isinstance(node, tuple):
                told.add(node[1])
            elif node >= 0:
                told.update(children[node])
                if node and e < most[node]:
                    told.update(*(children[x] for x in children[node].values()))
        if (0, 0) in states:
            told.update(b for b in used if any(BARE[b] == BARE[x] for x in children[0]))
        row = None
        for byte in (None, *told):
            target = step(states, byte)
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            if row is None:
                row = np.full(len(used) + 1, numbers[target], np.int32)
            else:
                row[classes[byte]] = numbers[target]
        rows.append(row)
    ended = [best(s) for s in order]
    return Automaton(classes, np.array(rows, np.int32), np.array([x[1] for x in ended], np.int32), np.array([x[0] for x in ended], np.int32))


@dataclass
class Model:
    terms: list[str]
    automaton: Automaton
    #: By (term, misspelled, quoted, many).
    weights: dict[tuple[int, bool, bool, bool], float] = field(default_factory=dict)
    base: float = 0.0


def quotations(texts: K.Texts, marks: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the words ``found`` are quoted or reported; ``marks``: where quotation marks stand."""
    so_far = np.concatenate([[0], np.cumsum(marks)])
    owner = np.searchsorted(texts.first, found, side="right") - 1
    low, high = texts.first[owner], texts.first[owner + 1] - 1
    before = so_far[texts.start[found]] - so_far[texts.start[np.maximum(found - WINDOW, low)]]
    after = so_far[np.minimum(texts.end[np.minimum(found + WINDOW, high)] + 1, texts.bounds[owner + 1])] - so_far[texts.end[found]]
    quoted = (before > 0) & (after > 0)
    raw, start, end = texts.data.tobytes(), texts.start, texts.end
    for k, word in enumerate(found):
        quoted[k] = quoted[k] or any(raw[start[i] : end[i]] in REPORTING for i in range(max(word - WINDOW - 1, low[k]), word))
    return quoted


def hits(model: Model, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, bool, bool, bool]]:
    """(text, term, misspelled, quoted, many) of each hit of a slice; many: different words of the text match the term."""
    data, bounds, marks = folded(data, bounds)
    texts = K.Texts(data, bounds)
    found, terms, edits = model.automaton.match(texts)
    if not len(found):
        return
    owner = np.searchsorted(texts.first, found, side="right") - 1
    words = texts.word_hashes(_WORD, _CODES)[found]
    place = owner * len(model.terms) + terms
    kinds = np.unique(np.stack([place.astype(np.uint64), words], axis=1), axis=0)[:, 0]
    many = np.isin(place, kinds[1:][kinds[1:] == kinds[:-1]].astype(np.int64))
    for k, quoted in enumerate(quotations(texts, marks, found)):
        yield int(owner[k]), int(terms[k]), bool(edits[k] > 0), bool(quoted), bool(many[k])


def score_slice(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    best: dict[int, dict[int, float]] = {}
    for text, *kind in hits(model, data, bounds):
        own, weight = best.setdefault(text, {}), model.weights.get(tuple(kind), 0.0)
        own[kind[0]] = max(own.get(kind[0], 0.0), (weight - model.base) / max(1.0 - model.base, 1e-9))
    scores = np.full(len(bounds) - 1, model.base)
    for text, own in best.items():
        scores[text] = 1.0 - (1.0 - model.base) * np.prod([1.0 - w for w in own.values()])
    return np.clip(scores, 0.0, 1.0)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, text`` of the labelled rows that are learnt from, one for equal texts with one label."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("of"), F.col("toxic").cast("int").alias("toxic")).where(~held_out("of"))
    sample = hash_sample(known, "of", TRAIN_DOCS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    one = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("of")).groupBy("toxic", F.md5("text")).agg(F.min("of").alias("of")).select("of", "toxic")
    return texts.join(F.broadcast(stored(one, "toxicity-sample", small=True)), F.col("doc_id") == F.col("of")).select("toxic", "text")


def free_words(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, int]]]:
    """``toxic`` and the words that are not quoted of each text, with the least hash of their neighbours."""
    marks = batch.column("toxic").to_pylist()
    for a, b, data, bounds in K.slices(batch.column("text")):
        data, bounds, at_marks = folded(data, bounds)
        texts = K.Texts(data, bounds)
        quoted, raw = quotations(texts, at_marks, np.arange(len(texts.start))), texts.data.tobytes()
        hashes = np.concatenate([np.zeros(1, np.uint64), texts.word_hashes(_WORD, _CODES), np.zeros(1, np.uint64)])
        around = K.mix(K.mix(hashes[:-2]) + hashes[2:]).view(np.int64)
        for k in range(b - a):
            at = np.flatnonzero(~quoted[texts.first[k] : texts.first[k + 1]]) + texts.first[k]
            own: dict[str, int] = {}
            for s, e, near in zip(texts.start[at].tolist(), texts.end[at].tolist(), around[at].tolist()):
                x = raw[s:e].decode("latin-1")
                own[x] = min(own.get(x, near), near)
            yield marks[a + k], own


def terms_of(words: dict[str, int]) -> dict[str, int]:
    """The terms that a text has, with their least hash: its words, their beginnings (``*``), and those of several words (``**``)."""
    out = dict(words)
    for word, near in words.items():
        for n in STEMS:
            if len(word) > n:
                stem = f"{word[:n]}*"
                if stem in out:
                    out[f"{stem}*"] = out[stem] = min(out[stem], near)
                else:
                    out[stem] = near
    return out


def origins(train: DataFrame, terms: set[str]) -> DataFrame:
    """``term, origins``: toxic documents with the terms, those with the same neighbours counted once."""
    shared = train.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for toxic, words in free_words(batch):
                if toxic:
                    seen.update(x for x in terms_of(words).items() if x[0] in shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.int64())], names=["term", "near"])

    return train.mapInArrow(run, "term string, near long").distinct().groupBy("term").agg(F.count("*").alias("origins"))


def learn_terms(train: DataFrame) -> list[str]:
    """Words, and beginnings of words with ``*``, that mark toxic documents, the latter perhaps only where several words have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([x[k] for x in counts.values()], pa.int64()) for k in (0, 1))], names=["term", "clean", "toxic"])

        counts: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, words in free_words(batch):
                for term in terms_of(words):
                    counts.setdefault(term, [0, 0])[toxic] += 1
                if len(counts) > 300_000:
                    yield out(counts)
                    counts = {}
        yield out(counts)

    sums = stored(train.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic"))), "toxicity-terms", small=True)
    tested = sums.count()
    documents = {x["toxic"]: x["n"] for x in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not tested or len(documents) < 2:
        return []
    base = documents[1] / sum(documents.values())
    evidence = f"toxic * ln(toxic / ((toxic + clean) * {base}D)) + coalesce(clean * ln(nullif(clean, 0) / ((toxic + clean) * {1 - base}D)), 0)"
    telling = f"toxic > clean AND toxic > {base}D * (toxic + clean) AND evidence >= ln({tested})"
    told = lambda rows: rows.where("toxic > 0").selectExpr("term", "toxic", "clean", f"{evidence} AS evidence").where(telling)
    # The terms of a bounded number of documents.
    likely = stored(told(sums).select("term", "clean"), "toxicity-likely", small=True)
    apart = likely.join(origins(train, {x["term"] for x in likely.collect()}), "term").select("term", "clean", F.col("origins").alias("toxic"))
    ranked = told(apart).orderBy(F.desc("evidence"), F.col("term").endswith("*"), F.desc(F.length("term")), "term").select("term").collect()
    # A beginning stands for the words that start with it, where it tells more than any of them.
    chosen: list[str] = []
    stems: set[str] = set()
    begun: set[str] = set()
    for (term,) in ranked:
        stem = term.rstrip("*")
        if any(stem[:n] in stems for n in STEMS) or term.endswith("*") and stem in begun:
            continue
        chosen.append(stem + "*" * term.endswith("*"))
        begun.update(stem[:n] for n in STEMS)
        if term.endswith("*"):
            stems.add(stem)
    return sorted(chosen)


def train_model(docs: DataFrame, labels: DataFrame) -> Model:
    train = training_rows(docs, labels)
    terms = learn_terms(train)
    model = Model(terms, intersect(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bool, bool, bool, int], int] = {}
        for batch in batches:
            marks = batch.column("toxic").to_pylist()
            for a, b, data, bounds in K.slices(batch.column("text")):
                per: dict[int, set] = {k: set() for k in range(b - a)}
                for text, *kind in hits(model, data, bounds):
                    per[text].add(tuple(kind))
                for k, kinds in per.items():
                    for kind in kinds or {(-1, False, False, False)}:
                        key = (*kind, marks[a + k])
                        counts[key] = counts.get(key, 0) + 1
        columns = list(zip(*((*k, n) for k, n in counts.items()))) or [[]] * 6
        kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["term", "misspelled", "quoted", "many", "toxic", "n"])

    got = train.mapInArrow(run, "term int, misspelled boolean, quoted boolean, many boolean, toxic int, n long").groupBy("term", "misspelled", "quoted", "many", "toxic").agg(F.sum("n").alias("n")).collect()
    seen: dict[tuple[int, bool, bool, bool], list[int]] = {}
    for *kind, toxic, n in got:
        seen.setdefault(tuple(kind), [0, 0])[toxic] += n
    clean, toxic = seen.pop((-1, False, False, False), [0, 0])
    model.base = toxic / (clean + toxic) if clean + toxic else 0.0
    # Where the misspellings of a family of terms are other words, unseen ones are likely to be, too.
    families: dict[tuple[str, bool], list[int]] = {}
    for (term, misspelled, quoted, many), (c, t) in seen.items():
        if misspelled and not quoted:
            own = families.setdefault((terms[term][:FAMILY], many), [0, 0])
            own[0], own[1] = own[0] + c, own[1] + t
    for many in (False, True):
        alike = [x for (_, m, q, several), x in seen.items() if not m and not q and several == many]
        share = (sum(x[1] for x in alike) + 1) / (sum(map(sum, alike)) + 2)
        for term, misspelled in product(range(len(terms)), (False, True)):
            prior = share
            if misspelled:
                clean_kin, toxic_kin = families.get((terms[term][:FAMILY], many), (0, 0))
                prior = (toxic_kin + UNSEEN_MISSPELLED) / (clean_kin + toxic_kin + 1)
            c, t = seen.get((term, misspelled, False, many), (0, 0))
            plain = model.weights[term, misspelled, False, many] = (t + prior) / (c + t + 1)
            if misspelled and plain < UNSEEN_MISSPELLED:  # mostly other words
                plain = model.weights[term, misspelled, False, many] = plain * plain
            c, t = seen.get((term, misspelled, True, many), (0, 0))
            model.weights[term, misspelled, True, many] = (t + 0.2 * plain) / (c + t + 1)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in K.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score_slice(shared.value, data, bounds))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train_model(docs, labels))
