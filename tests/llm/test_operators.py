import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import decontamination, kernel, line_dedup, maxent, mixing, near_dedup, quality_model, quality_rules, substring_dedup, toxicity, warc

from .brute import collected, corpus, empty, lower, odd, prose, words

ROWS = corpus()
TEXTS = st.lists(st.text("aAé \n\t\x0b.!|#日", max_size=40), min_size=1, max_size=6)


# The kernel

@given(TEXTS)
def test_words(texts):
    for a, b, data, bounds in kernel.slices(pa.array(texts), 50):
        found = kernel.Texts(data, bounds)
        got = [data[s:e].tobytes().decode() for s, e in zip(found.start, found.end)]
        assert got == [w for t in texts[a:b] for w in words(t)]
        assert found.counts.tolist() == [len(words(t)) for t in texts[a:b]]
        hashes = found.word_hashes(kernel.Roller(1), kernel.byte_codes(2))
        assert len(set(hashes.tolist())) == len(set(got))


def test_slices_of_a_part():
    column = pa.array(["x", "ab", None, "cd"]).slice(1)
    assert [data.tobytes() for _, _, data, _ in kernel.slices(column, 3)] == [b"ab", b"cd"]


# Quality rules

def rules_of(text):
    t = text or ""
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    marked = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked), failed


def test_quality_rules(spark):
    got = quality_rules.quality_rules(odd(spark))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(got, *columns) == sorted(((r[0], *rules_of(r[1])) for r in ROWS), key=repr)
    assert not got.where("base_failed AND kept").count()
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_line_rules(spark):
    rng = random.Random(1)
    good = "\n".join(prose(rng, 12, 5000) + " x%d" % k for k in range(9))
    junk = "\n".join(" | ".join(prose(rng, 12, 5000).split()) for _ in range(12))
    rows = [(1, good, "en", "s", 1), (2, f"{good}\n{junk}", "en", "s", 1), (3, f"Licensed under CC.\n{good}", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert collected(quality_rules.quality_rules(df), "doc_id", "kept", "n_bad_navigation") == [(1, True, 0), (2, False, 12), (3, True, 0)]
    assert collected(quality_rules.clean_lines(df), "text")[0] == collected(quality_rules.clean_lines(df.where("doc_id = 1")), "text")[0] == (good,)


# Mixing

def test_mixing(spark):
    out = mixing.mix_sources(odd(spark))
    got = out.collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len(words(r[1]))) for r in ROWS)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    total, weights, caps = sum(sizes.values()), {"a": 1, "b": 2, None: 3}, {s: 3 * n for s, n in sizes.items()}
    want, open_, left = {}, set(sizes), float(total)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if caps[s] <= weights[s] * level}
        for s in full or open_:
            want[s] = caps[s] if full else weights[s] * level
            left -= want[s] if full else 0
        open_ = open_ - full if full else set()
    assert targets == pytest.approx(want)
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=40)
    assert sorted(out.collect()) == sorted(mixing.mix_sources(odd(spark).repartition(5)).collect())
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert {r["taken"] for r in mixing.mix_sources(odd(spark).where("doc_id IN (1, 2, 5)")).collect()} == {0}


@pytest.mark.parametrize("blocks", [1, 2, 7, 64, 100])
def test_permutation(spark, blocks):
    x = spark.range(blocks).selectExpr(f"{blocks}L AS blocks", "id", f"{mixing.round_keys(chr(39) + 'k' + chr(39))} AS keys").selectExpr(f"{mixing.permuted('id', 'blocks', 'keys')} AS y")
    assert sorted(r["y"] for r in x.collect()) == list(range(blocks))


# WARC

PAGES = "page_id long, url string, html string, first int"


def test_warc(spark):
    rng = random.Random(2)
    rows = [(k, f"http://x/{k}", f"<p>{prose(rng, 50)}</p>" if k % 5 else "<p>same é</p>", 1) for k in range(1, 60)]
    rows += [(60, None, None, 1), (61, "u\r\nv", "", 1), (4, "http://x/4", rows[3][2], 1), (None, "n", "<p>same é</p>", 1), (70, "b", "WARC/1.1\r\n\r\n" * 3, 1)]
    got = warc.archived_pages(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    first = {}
    for page_id, _, html, _ in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    import base64

    want = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        want.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), first[html or ""]))
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) if r["page_id"] is not None else (-1,) for r in got) == sorted(w[:3] if w[0] is not None else (-1,) for w in want)
    kinds = defaultdict(list)
    for r in got:
        kinds[r["page_id"]].append((r["record_type"], r["refers_to"]))
    assert sorted(kinds.pop(4)) == [("response", None), ("revisit", 4)]
    assert kinds.pop(None) == [("revisit", 5)]
    for page_id, _, _, f in want:
        if page_id not in (4, None):
            assert kinds[page_id] == [("response", None) if page_id == f else ("revisit", f)]
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


@settings(deadline=None, max_examples=30)
@given(st.lists(st.binary(max_size=300), max_size=12))
def test_archive_round_trip(payloads):
    import io

    records = [warc.record(k, "u", p, "D", None, False) for k, p in enumerate(payloads)]
    raw = io.BytesIO(b"".join(warc.archive_frames(iter(records))))
    back = list(warc.read_records(warc.open_archive(raw)))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in back] == payloads
    assert [int(h["X-Page-ID"]) for h, _ in back] == list(range(len(payloads)))


def test_dictionary_frame():
    rng = random.Random(3)
    records = [warc.record(k, f"http://x/{k}", f"<p>{prose(rng, 80)}</p>".encode(), "D", None, False) for k in range(200)]
    frames = list(warc.archive_frames(iter(records)))
    assert frames[0][:4] == b"\x5d\x2a\x4d\x18" and len(frames) == 201
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(frames[0][8:]))
    one = zstandard.ZstdDecompressor(dict_data=dictionary)
    assert [one.decompress(f) for f in frames[1:]] == records
    assert sum(map(len, frames[1:])) < 0.7 * sum(len(zstandard.compress(r)) for r in records)


# LM scoring

def test_lm_base(spark):
    got = maxent.lm_scores(odd(spark)).collect()
    toks = [(r[0], [*words(lower(r[1])), " "]) for r in ROWS]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for k, t in toks if not held(k) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((k, held(k), len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for k, t in toks)
    got.sort(key=lambda r: r["doc_id"])
    for r, w in zip(got, want, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:5]
        assert r["base_score"] == pytest.approx(w[5]) and r["score"] < 0
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert maxent.lm_scores(empty(spark)).count() == 0


def test_lm_probabilities():
    """Over the classes, the words of a class and one unknown word per last class, a context's probabilities sum to one."""
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**62, 3000).astype(np.uint64))
    n = np.sort(rng.integers(1, 50, len(h)))[::-1].copy()
    middle = np.bincount((h & np.uint64(15)).astype(int), weights=n, minlength=16)
    found = maxent.Counts(int(n.sum()) + 10, len(h) + 1, 10, h, n, np.zeros(16), np.full(16, 3.0))
    assert middle.sum() == n.sum()
    found.prepare()
    weights, top = (rng.normal(size=x.shape).astype(np.float32) for x in maxent.blank(14))
    context = [np.array([5]), np.array([77]), np.array([9]), np.array([1])]
    classes = np.exp(maxent.log_softmax(weights, context, found.bias))[0].astype(float)
    total = classes[maxent.END_CLASS]
    for c in range(maxent.TOP_CLASSES):
        rows = maxent.word_rows(context, np.array([c]), 14)
        total += classes[c] * np.exp(maxent.log_softmax(top, rows, found.top_bias[[c]])).sum()
    rank = np.arange(len(h))
    shares = np.exp(found.share.astype(float))
    for c in range(maxent.TOP_CLASSES, maxent.END_CLASS):
        total += classes[c] * (shares[(found.classes == c) & (rank >= maxent.TOP)].sum() + (1 if c >= maxent.TOP_CLASSES + maxent.ENDINGS else 0))
    empty_middle = [c for c in range(maxent.TOP_CLASSES, maxent.TOP_CLASSES + maxent.ENDINGS) if not (found.classes == c).any()]
    assert not empty_middle and total == pytest.approx(1, abs=1e-4)


def test_lm_layout(spark):
    """Scores do not depend on how the table is cut."""
    table = odd(spark)
    a, b = (collected(maxent.lm_scores(t), "doc_id", "n_tokens", "score") for t in (table.coalesce(1), table.repartition(5)))
    assert a == b


def test_lm_changes_follow_the_tokens(spark, monkeypatch):
    """What training writes is bounded for each token, and sums within a task teach what sums of single shards do."""
    for total in (10**6, 10**7, 10**8, 10**9, 10**10):
        bits = maxent.Counts(total, 1, 1, *[np.zeros(1)] * 4).bits
        shards, tasks = maxent.train_tasks(total, bits)
        assert shards >= tasks >= min(shards, maxent.LEAST_TASKS)
        assert tasks * maxent.ROUNDS * sum(x.nbytes for x in maxent.blank(bits)) <= max(4 * total, 110 * 10**6)
    monkeypatch.setattr(maxent, "SHARD_TOKENS", 200)
    learnt, found = odd(spark).where(~maxent.held_out()), []
    counts = maxent.gather_counts(maxent.token_counts(learnt))
    for least in (1, 3, 100):
        monkeypatch.setattr(maxent, "LEAST_TASKS", least)
        found.append(maxent.train(learnt, counts))
    assert maxent.train_tasks(counts.total, counts.bits)[0] > 3 and abs(found[0][0]).max() > 0.01
    for weights in found[1:]:
        for x, y in zip(found[0], weights, strict=True):
            assert np.allclose(x, y, atol=1e-5)


def test_lm_lookup():
    h = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    h[1:100] = h[0] + np.arange(1, 100).astype(np.uint64)
    find = maxent.Lookup(h)
    assert (find(h) == np.arange(len(h))).all() and (find(h + np.uint64(1 << 40)) == -1).all()


# Line deduplication

def lines_left(rows):
    k, long_words = line_dedup.RUN_LINES, line_dedup.LONG_WORDS
    runs, first = [], {}
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}):
        kept = [(i, x) for i, x in enumerate(text.split("\n")) if words(x)]
        for p in range(len(kept)):
            if p + k <= len(kept):
                runs.append((doc_id, p, tuple(x for _, x in kept[p : p + k]), [i for i, _ in kept[p : p + k]]))
            if len(words(kept[p][1])) >= long_words:
                runs.append((doc_id, p, (kept[p][1],), [kept[p][0]]))
    for doc_id, p, run, _ in runs:
        first[run] = min(first.get(run, (doc_id, p)), (doc_id, p))
    gone = defaultdict(set)
    for doc_id, p, run, at in runs:
        if first[run] < (doc_id, p):
            gone[doc_id].update(at)
    return sorted(((r[0], "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[r[0]]) if gone[r[0]] else r[1], len(gone[r[0]])) for r in rows), key=repr)


def test_line_dedup(spark):
    out = line_dedup.dedup_lines(odd(spark))
    assert collected(out, "doc_id", "text", "lines_removed") == lines_left(ROWS)
    assert set(odd(spark).columns) < set(out.columns) and line_dedup.dedup_lines(empty(spark)).count() == 0


# Toxicity

def distance(a, b):
    """Edits, an exchange of neighbours being one."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("abc", min_size=1, max_size=11), min_size=1, max_size=5, unique=True), st.lists(st.text("abcd", min_size=1, max_size=12), min_size=1, max_size=20))
def test_automaton(terms, candidates):
    found = toxicity.intersect(terms)
    data = " ".join(candidates).encode()
    texts = kernel.Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    hit, _, edits = found.match(texts)
    want = {}
    for k, w in enumerate(candidates):
        near = [distance(w, t) for t in terms if t[0] == w[0] and distance(w[1:], t[1:]) <= toxicity.edits_allowed(t)]
        if near:
            want[k] = min(distance(w[1:], t[1:]) for t in terms if t[0] == w[0] and distance(w[1:], t[1:]) <= toxicity.edits_allowed(t))
    assert dict(zip(hit.tolist(), edits.tolist())) == want


def test_misspellings_are_code_points():
    terms = [t.lower().encode().decode() for t in ("crétin", "connard", "überlegen")]
    found = toxicity.intersect(terms)
    raw = " ".join(("cretin", "conñard", "uberlegen", "CRÉTIN", "creten", "überlegen")).encode()
    data, bounds, _ = toxicity.folded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    hit, term, edits = found.match(kernel.Texts(data, bounds))
    assert [(int(h), terms[t], int(e)) for h, t, e in zip(hit, term, edits)] == [(0, "crétin", 1), (1, "connard", 1), (2, "überlegen", 1), (3, "crétin", 0), (5, "überlegen", 0)]


def test_toxicity(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        w = prose(rng, 60).split()
        if toxic:
            w[rng.randrange(5, 55)] = rng.choice(["badword", "terrible", "grumpf"])
        docs.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    docs += [(1000, prose(rng, 30) + " terribel " + prose(rng, 30), None, None, 1), (1001, None, None, None, None), (1002, "", None, None, 0), (1003, "w1 said w2 \"badword\" w3 w4", None, None, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(odd(spark, docs), known).collect()}
    assert len(got) == len(docs) and all(got[k]["predicted"] == t for k, _, t in labels)
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == got[1002]["predicted"] == 0
    assert got[1003]["score"] < got[0]["score"]
    assert toxicity.toxicity(empty(spark), known).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd(spark, docs), known.where("false")).collect()} == {0.0}


def test_rare_and_quoted_terms(spark):
    """A hundred terms in one percent of the toxic documents each, and one that as many clean documents quote."""
    rng = random.Random(14)
    terms = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(100)]
    rows = [(1, f"{prose(rng, 6, 200)} {terms[k % 100]} {prose(rng, 6, 200)}") for k in range(1200)]
    rows += [(1, f"{prose(rng, 6, 200)} insultus {prose(rng, 6, 200)}") for _ in range(60)]
    rows += [(0, f'{prose(rng, 6, 200)} said "insultus" {prose(rng, 6, 200)}') for _ in range(60)]
    rows += [(0, prose(rng, 13, 200)) for _ in range(2400)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, (_, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, 1, x) for k, (x, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).where("held_out").collect()}
    rare, used, quoted, clean = ([x for k, x in got.items() if a <= k < b] for a, b in ((0, 1200), (1200, 1260), (1260, 1320), (1320, len(rows))))
    assert np.mean(rare) > 0.95 and np.mean(used) == 1 and not any(quoted) and np.mean(clean) < 0.01


# Substring deduplication

def test_substring_dedup(spark):
    first = {}
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), doc_id)
    want = []
    for doc_id, text, *_ in ROWS:
        w = words(text)
        lost = {i + d for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < doc_id for d in range(13)}
        want.append((doc_id, len(w), len(lost), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in lost).encode()).hexdigest()))
    got = substring_dedup.dedup_report(odd(spark))
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.dedup_report(empty(spark)).count() == 0
    nameless = spark.createDataFrame([(None, ROWS[0][1], "en", "s", 1), (7, ROWS[0][1], "en", "s", 1)], odd(spark).select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert collected(substring_dedup.dedup_report(nameless), "n_removed") == [(0,), (0,)]


@given(st.lists(st.integers(0, 2**32 - 1), unique=True))
def test_packing(values):
    values = np.array(sorted(values), np.uint32)
    assert (substring_dedup.unpack(substring_dedup.pack(values)) == values).all()


# Near duplicates

def groups_of(rows, percent=near_dedup.PERCENT):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words(lower(text))
        sets[doc_id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return sorted(((r[0], len(sets[r[0]]), find(r[0]), find(r[0]) == r[0]) for r in rows), key=repr)


def test_near_groups(spark):
    assert collected(near_dedup.near_groups(odd(spark)), "doc_id", "n_shingles", "component_id", "kept") == groups_of(ROWS)
    assert near_dedup.near_groups(empty(spark)).count() == 0
    left = near_dedup.one_of_each(odd(spark))
    assert collected(left, "doc_id") == sorted({(r[0],) for r in groups_of(ROWS) if r[3]}, key=repr)


def test_two_texts_under_one_id(spark):
    """They are documents of their own: neither replaces the other."""
    rng = random.Random(31)
    a, b, c = (prose(rng, 60, 5000) for _ in range(3))
    table = odd(spark, [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 1), (3, c, "en", "s", 1)])
    assert sorted(x for (x,) in collected(near_dedup.one_of_each(table), "text")) == sorted([a, b, c])


def test_template_with_random_edits(spark, monkeypatch):
    """Many documents that are nearly similar enough: right groups, and pairs that do not grow with the square."""
    formed = []
    real = near_dedup._meeting_places
    monkeypatch.setattr(near_dedup, "STAR_FIRST", 2)
    monkeypatch.setattr(near_dedup, "_meeting_places", lambda *a: formed.append(1) or real(*a))
    rng, rows = random.Random(3), []
    for k in range(150):
        own = [f"w{i}" for i in range(102)]
        for _ in range(2):
            own[rng.randrange(102)] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(own), "en", "s", 1))
    assert collected(near_dedup.near_groups(odd(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == groups_of(rows)
    assert formed


def test_labels_at_open_keys_only(spark, monkeypatch):
    """Once stars are linked, rows at keys that can still give pairs get new labels, each once; all others do not."""
    made = defaultdict(list)
    real = near_dedup.stored

    def counted(df, name, small=False):
        out = real(df, name, small)
        made[name].append(out)
        return out

    monkeypatch.setattr(near_dedup, "STAR_FIRST", 2)
    monkeypatch.setattr(near_dedup, "stored", counted)
    rng, rows = random.Random(3), []
    for k in range(150):
        own = [f"w{i}" for i in range(102)]
        for _ in range(2):
            own[rng.randrange(102)] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(own), "en", "s", 1))
    assert collected(near_dedup.near_groups(odd(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == groups_of(rows)
    before, after = (x.count() for x in made["near-met"])
    assert after == before == made["near-keys"][0].agg(F.sum("n")).first()[0] < made["near-places"][0].count()
    assert made["near-named"][0].count() == made["near-buckets"][0].count()


def test_large_near_group(spark):
    """Many edited copies of one text, most of them linked to it and not to each other."""
    rng = random.Random(6)
    base = prose(rng, 90, 5000).split()
    rows = []
    for k in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1, 1])] = [f"e{rng.randrange(40)}"]
        rows.append((k, " ".join(own[: rng.choice([90, 90, 80])]), "en", "s", 1))
    assert collected(near_dedup.near_groups(odd(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == groups_of(rows)


def test_superminhash_estimates():
    rng = np.random.default_rng(7)
    for share in (0.5, 0.85):
        both = int(200 * share)
        errors = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 400 - both).astype(np.uint64)
            a, b = x[:200], np.concatenate([x[:both], x[200:]])
            s = near_dedup.superminhash(np.concatenate([a, b]), np.array([200, len(b)]))
            errors.append((s[0] == s[1]).mean() - both / len(x))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 1.1 * math.sqrt(both / len(x) * (1 - both / len(x)) / near_dedup.SLOTS)


def test_components(spark):
    rng = random.Random(8)
    edges = [(a, a + 1) for a in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: y for x, y in label.items() if x != y}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Quality model

def test_quality_model(spark):
    rng = random.Random(9)
    docs = [(k, prose(rng, 80), rng.choice(["en", "de", None]), "s", 1) for k in range(200)]
    docs += [(k, " ".join(f"{w.upper()}!!" for w in prose(rng, 80).split()), "en", "s", 1) for k in range(200, 220)]
    docs += [(300, None, "en", "s", 1), (301, "", None, None, 0), (302, "again " * 100, "de", "s", 1)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    table = odd(spark, docs)
    verdict = {r["doc_id"]: r["kept"] for r in quality_model.classify(table, labels).collect()}
    assert all(verdict[k] for k in range(200)) and not any(verdict[k] for k in verdict if k >= 200)
    kept = quality_model.good_only(table, labels)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(200))
    assert quality_model.classify(empty(spark), labels).count() == quality_model.good_only(empty(spark), labels).count() == 0
    assert quality_model.classify(table, labels.where("false")).where("kept").count() == 221


def test_model_is_a_distribution(spark):
    rng = random.Random(10)
    texts = spark.createDataFrame([(prose(rng, 50),) for _ in range(30)], "text string")
    p = np.concatenate(list(quality_model.kneser_ney(dense(quality_model.symbol_counts(texts)))))
    assert np.allclose(p.reshape(-1, quality_model.SYMBOLS).sum(axis=1), 1, atol=1e-4)


def dense(counts):
    table = np.zeros(quality_model.SYMBOLS**quality_model.ORDER, np.uint32)
    for gram, n in counts.collect():
        table[gram] = n
    return table


def plain_kneser_ney(grams):
    """Interpolated modified Kneser-Ney by its definition, over tuples; returns p(symbol, context)."""
    levels = {quality_model.ORDER: Counter(grams)}
    for order in range(quality_model.ORDER - 1, 0, -1):
        levels[order] = Counter(g[1:] for g in levels[order + 1])
    cuts = {}
    for order, counts in levels.items():
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        cuts[order] = [0.0] + [min(max(k - (k + 1) * y * (n[k + 1] / n[k] if n[k] else 1), 0.0), k - 0.1) for k in (1, 2, 3)]

    def p(symbol, context):
        order = len(context) + 1
        below = p(symbol, context[1:]) if context else 1 / quality_model.SYMBOLS
        after = {g[-1]: c for g, c in levels[order].items() if g[:-1] == context}
        if not after:
            return below
        total = sum(after.values())
        own = after.get(symbol, 0)
        return (own - cuts[order][min(own, 3)]) / total + sum(cuts[order][min(c, 3)] for c in after.values()) / total * below

    return p


def test_kneser_ney_by_definition(spark):
    texts = ["the cat sat on the mat", "a cat, a hat; the bat sat", "THE 99 cats!"]
    codes = np.concatenate([quality_model.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts])
    tuples = [tuple(int(c) // quality_model.SYMBOLS**k % quality_model.SYMBOLS for k in (3, 2, 1, 0)) for c in codes]
    model = np.concatenate(list(quality_model.kneser_ney(dense(quality_model.symbol_counts(spark.createDataFrame([(t,) for t in texts], "text string")))))).reshape(-1)
    plain = plain_kneser_ney(tuples)
    for c, g in [*zip(codes, tuples), *((int(c) + 1, (*g[:3], g[3] + 1)) for c, g in zip(codes, tuples) if g[3] < 62), (5, (0, 0, 0, 5))]:
        assert model[c] == pytest.approx(plain(g[3], g[:3]), rel=1e-4)


def test_all_trusted_documents_count(spark, monkeypatch):
    """The model learns from every trusted document, and every held-out one sets the bounds, broadcast or not."""
    ids = spark.range(90_000).withColumnRenamed("id", "doc_id")
    docs, labels = ids.selectExpr("doc_id", "concat('text ', doc_id) AS text", "'en' AS lang"), ids.selectExpr("doc_id", "CAST(doc_id % 10 > 0 AS INT) AS quality")
    for most in (quality_model.BROADCAST_IDS, 0):
        monkeypatch.setattr(quality_model, "BROADCAST_IDS", most)
        learnt = quality_model.trusted_texts(docs, labels)
        held = quality_model.trusted(labels, True)
        assert learnt.count() + held.count() == 81_000 and held.count() > 16_384
        assert learnt.join(held, F.expr("text = concat('text ', of)")).count() == 0


def test_copies_set_no_bound(spark):
    """A text that holds most of a language's rows does not lose the other documents, nor do languages of two documents."""
    rng = random.Random(19)
    same = prose(rng, 80)
    docs = [(k, same, "en", "s", 1) for k in range(200)] + [(k, prose(rng, 80), "en", "s", 1) for k in range(200, 300)] + [(400, prose(rng, 80), "xx", "s", 1), (401, prose(rng, 60), "xx", "s", 1)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150, 300)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_model.classify(odd(spark, docs), labels).where("kept").collect()}
    assert kept >= {*range(200), 400, 401} and len(kept) >= 296


# Decontamination

def clean(text):
    return ["".join(c for c in w if c.isalnum()) for w in words((text or "").lower())]


def test_decontamination(spark):
    rng = random.Random(11)
    items = [prose(rng, n, 3000) for n in (3, 5, 6, 12, 20, 40, 59)] + [None, "", "!!!"]
    docs = [prose(rng, 200, 3000) for _ in range(30)]
    for k, item in enumerate(items[:7]):
        docs[k] += " " + item + " " + prose(rng, 50, 3000)
        own = item.split()
        own[0] = "other"
        docs[k + 10] += " " + " ".join(own).upper() + "!"
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(docs)] + [(99, None, "en", "s", 1), (0, docs[0], "en", "s", 1)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, item in enumerate(items):
        w = [x for x in clean(item) if x]
        k = min(5, len(w))
        shingles = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, text, *_ in rows:
            t = [x for x in clean(text) if x]
            found = len(shingles & {tuple(t[j : j + k]) for j in range(len(t) - k + 1)})
            if shingles and 5 * found >= 4 * len(shingles):
                want.add((d, i, len(shingles), found))
    table = odd(spark, rows)
    got = decontamination.find_items(table, bench)
    assert collected(got, "doc_id", "item_id", "n_item", "n_found") == sorted(want, key=repr) and len(want) >= 8
    left = decontamination.without_items(table, bench)
    assert left.columns == table.columns and {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - {w[0] for w in want}
    assert decontamination.find_items(empty(spark), bench).count() == decontamination.find_items(table, bench.where("false")).count() == 0


def test_rows_without_id(spark):
    """Two rows without doc_id among others: every operator keeps them as rows of their own."""
    rows = [*ROWS[:20], (None, ROWS[4][1], None, None, None), (None, None, None, None, None)]
    table, labels = odd(spark, rows), spark.createDataFrame([(k, 1, 0) for k in range(10)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, ROWS[4][1]), (1, None)], "item_id long, text string")
    for out in (
        quality_rules.quality_rules(table), mixing.mix_sources(table), maxent.lm_scores(table), line_dedup.dedup_lines(table), toxicity.toxicity(table, labels),
        substring_dedup.dedup_report(table), near_dedup.near_groups(table), quality_model.classify(table, labels),
    ):
        assert out.count() == len(rows) and out.where("doc_id IS NULL").count() == 2
    assert {None, 4} <= {r["doc_id"] for r in decontamination.find_items(table, bench).collect()}
    assert near_dedup.one_of_each(table).where("doc_id IS NULL").count() == 2


def test_table_out_of_sight(spark, tmp_path):
    """A folder that a task cannot see is an error, a part without rows is none."""
    from textloom.llm import common

    path = common.stored_at(spark.createDataFrame([(1, 5)], "chunk long, x int"), "part")
    with pytest.raises(FileNotFoundError):
        common.read_part(f"file://{tmp_path}/elsewhere", "chunk=1")
    assert common.read_part(path, "chunk=7") is None and common.read_part(path).num_rows == 1
    assert common.shared_dir(spark).startswith("file:///")


def test_small_source_of_a_mix(spark):
    """A source of few words meets its target beside a large one."""
    rows = [(k, "w " * 2000, "en", "big", 1) for k in range(60)] + [(k, "w " * 20, "en", "small", 1) for k in range(100, 105)]
    got = mixing.mix_sources(odd(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    for r in got:
        assert r["taken"] == pytest.approx(r["target"], rel=0.01, abs=2)
    slots = mixing.draw_slots(mixing.with_blocks(mixing.source_targets(odd(spark, rows).select("source", F.lit(100).cast("long").alias("size")))))
    shards = slots.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("place").alias("places")).orderBy("shard").collect()
    assert all(r["n"] == r["places"] for r in shards) and all(r["n"] == mixing.SHARD_SLOTS for r in shards[:-1])


def test_very_long_texts(spark):
    """Texts beyond a slice of work, of which one repeats another."""
    rng = random.Random(41)
    long = "\n".join(prose(rng, 12, 30_000) for _ in range(6000))
    assert len(long) > kernel.SLICE_BYTES
    rows = [(1, long, "en", "a", 1), (2, f"{long}\nsome more words at the end", "en", "b", 1), (3, "short text", "en", "a", 1)]
    table = odd(spark, rows)
    assert collected(near_dedup.near_groups(table), "doc_id", "n_shingles", "component_id", "kept") == groups_of(rows)
    assert collected(substring_dedup.dedup_report(table), "doc_id", "n_words", "n_removed")[1][2] == len(long.split())
    assert collected(line_dedup.dedup_report(table), "doc_id", "n_removed")[1][1] == 6000
    assert collected(quality_rules.quality_rules(table), "doc_id", "n_words")[0][1] == len(long.split())
    assert {r["doc_id"]: r["size"] for r in mixing.mix_sources(table).collect()}[1] == len(long.split())
