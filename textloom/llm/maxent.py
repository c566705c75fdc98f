"""Language-model scores from a hashed maximum-entropy model.

Words are lower-cased (A-Z) and known by a 64-bit hash whose low four bits are
a class of the word's ending; every text ends with one end token.  The model
factors the next token into its class and the token within the class:

* 16 classes for the 256 most frequent words, 16 by ending for the next
  16,128, 16 by ending for all others, and one for the end;
* a softmax over the classes, and one over the words of each of the first 16
  classes, whose logits sum hashed features: the previous word, the previous
  two, the word before the previous one (skip), and the endings of the last
  three; their biases are the logarithms of the counts;
* words of the other classes take their share of the class's count; in the
  last 16, the words seen once make room for one unknown word per class, so
  all probabilities of a context sum to one.

Counts are exact over all training tokens: partial counts per task, then one
aggregation by hash.  Training goes over every training document once, in
``ROUNDS`` rounds: documents are dealt to shards and ordered by hash; gradient
steps (AdaGrad) go from the common weights over each shard of the round, and the
changes, weighted by tokens, are summed: those of a task's shards where they
are made, then those of all tasks per block of weights by a shuffle.  A change is
as large as the model, so the number of tasks follows from what their changes may
take on disk, ``CHANGE_BYTES`` for each training token.  The rows of weights grow with the training tokens, from 16,384 to
131,072 (42 MB, a fixed bound on what is broadcast), and so n-grams collide
beyond some 500 million tokens as they do at 16,384 rows below 67 million.

Scoring works on sparse batches in numpy.  The ``HEAD`` most frequent words (a
fixed bound, ties at its end left out) are resolved in place; the rarer words of each document join the
count table by hash, so no vocabulary is broadcast.

Defined results: a null or empty text is the end token alone; equal rows are
scored alike and counted twice; a null doc_id is not held out; without any
training row N and V are 0 and every token is unknown; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import stored

ENDINGS = 16
TOP_CLASSES, TOP_EACH = 16, 16
TOP = TOP_CLASSES * TOP_EACH
MIDDLE = 16_384
HEAD = 262_144
CLASSES = TOP_CLASSES + 2 * ENDINGS + 1
END_CLASS = CLASSES - 1
END = np.uint64(0xE0D0E0D0E0D0E0D0)
#: Rows of weights, as powers of two: the least and the most, and tokens of training for each row.
LEAST_BITS, MOST_BITS, ROW_TOKENS_BITS = 14, 17, 12
FEATURES, WORD_FEATURES = 4, 2
ROUNDS = 3
#: Tokens of a shard, on average.
SHARD_TOKENS = 1 << 19
#: Bytes of changes that all rounds write for each training token, unless fewer than ``LEAST_TASKS`` were left for a round.
CHANGE_BYTES, LEAST_TASKS = 2, 8
RATE = 0.1
#: Tokens of a gradient step, and of a scoring batch.
STEP, BATCH = 65_536, 4096
#: Words that a task counts before it passes partial counts on.
COUNT_WORDS = 4_000_000
#: Blocks of weights that are summed apart.
BLOCKS = 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_CODES, _WORD = K.byte_codes(41), K.Roller(42)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, its end included, and where each text starts."""
    texts = K.Texts(LOWER[data], bounds)
    hashes = texts.word_hashes(_WORD, _CODES)
    last = texts.end - 1
    last = last - (_MARK[texts.data[last]] & (last > texts.start))
    before = np.maximum(last - 1, texts.start)
    ending = K.mix(texts.data[last].astype(np.uint64) * np.uint64(256) + texts.data[before].astype(np.uint64)) % np.uint64(ENDINGS)
    out = np.full(len(hashes) + texts.n, END, np.uint64)
    out[np.arange(len(hashes)) + texts.owner()] = (hashes & ~np.uint64(ENDINGS - 1)) | ending
    return out, texts.first + np.arange(texts.n + 1)


class Lookup:
    """Positions of hashes in a table, by a direct index on their high bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - 22)
        slot = (hashes >> self.shift).astype(np.int64)
        self.slots = np.full(1 << 22, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]  # the most frequent word wins
        rest = np.flatnonzero(self.slots[slot] != np.arange(len(hashes)))
        self.rest = rest[np.argsort(hashes[rest])]
        self.rest_hashes = hashes[self.rest]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = self.slots[(h >> self.shift).astype(np.int64)].astype(np.int64)
        wrong = np.flatnonzero((at >= 0) & (self.hashes[at] != h))
        at[wrong] = -1
        if len(self.rest) and len(wrong):
            k = np.minimum(np.searchsorted(self.rest_hashes, h[wrong]), len(self.rest) - 1)
            at[wrong] = np.where(self.rest_hashes[k] == h[wrong], self.rest[k], -1)
        return at


@dataclass
class Counts:
    """The training counts that every task needs: totals, and the most frequent words with theirs."""

    total: int
    distinct: int
    ends: int
    hashes: np.ndarray
    counts: np.ndarray
    #: Tokens and words seen once of the last 16 classes.
    rest_tokens: np.ndarray
    rest_once: np.ndarray

    def prepare(self) -> None:
        """Class, place in class and share of class of each frequent word."""
        self.find = Lookup(self.hashes)
        rank = np.arange(len(self.hashes))
        ending = (self.hashes & np.uint64(ENDINGS - 1)).astype(np.int64)
        self.classes = np.where(rank < TOP, rank % TOP_CLASSES, np.where(rank < MIDDLE, TOP_CLASSES, TOP_CLASSES + ENDINGS) + ending)
        sums = np.bincount(self.classes[:MIDDLE], weights=self.counts[:MIDDLE], minlength=CLASSES)
        sums[TOP_CLASSES + ENDINGS : END_CLASS] = self.rest_tokens + self.rest_room()
        sums[END_CLASS] = max(self.ends, 1)
        self.share = np.log(self.counts / np.maximum(sums[self.classes], 1)).astype(np.float32)
        self.bias = np.log(np.maximum(sums, 0.5) / np.maximum(sums, 0.5).sum()).astype(np.float32)
        self.top_bias = np.full((TOP_CLASSES, TOP_EACH), -30.0, np.float32)
        n = min(TOP, len(rank))
        self.top_bias[rank[:n] % TOP_CLASSES, rank[:n] // TOP_CLASSES] = self.share[:n]

    @property
    def bits(self) -> int:
        return min(MOST_BITS, max(LEAST_BITS, (self.total >> ROW_TOKENS_BITS).bit_length()))

    def rest_room(self) -> np.ndarray:
        return np.maximum(self.rest_once, 1)

    def class_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or -1) and class of each token."""
        rank = self.find(h)
        rest = TOP_CLASSES + ENDINGS + (h & np.uint64(ENDINGS - 1)).astype(np.int64)
        classes = np.where(rank >= 0, self.classes[rank], rest) if len(self.classes) else rest
        classes[h == END] = END_CLASS
        return rank, classes


def feature_rows(h: np.ndarray, starts: np.ndarray, bits: int) -> list[np.ndarray]:
    """The weight rows of each token's features."""
    starts = starts[:-1]

    def back(x: np.ndarray) -> np.ndarray:
        y = np.concatenate([np.zeros(1, np.uint64), x[:-1]])
        y[starts] = 0
        return y

    one = back(h)
    two = back(one)
    three = back(two)
    low = np.uint64(ENDINGS - 1)
    ends = ((one & low) << np.uint64(8)) | ((two & low) << np.uint64(4)) | (three & low)
    mixed = (one + np.uint64(1), K.mix(one + np.uint64(2)) + two, two + np.uint64(3), ends + np.uint64(4))
    return [(K.mix(x) >> np.uint64(64 - bits)).astype(np.int64) for x in mixed]


def word_rows(rows: list[np.ndarray], classes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(r * 31 + classes * 7919) % (1 << bits) for r in (rows[0], rows[3])]


def log_softmax(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    logits = weights[rows[0]]
    for r in rows[1:]:
        logits += weights[r]
    logits += bias
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def descend(weights: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step on a batch; slopes are summed by weight row one column at a time."""
    slope = np.exp(log_softmax(weights, rows, bias))
    slope[np.arange(len(target)), target] -= 1.0
    columns = np.ascontiguousarray(slope.T, np.float64)
    sums = np.stack([sum(np.bincount(r, column, len(weights)) for r in rows) for column in columns], axis=1).astype(np.float32)
    squares += sums * sums
    weights -= RATE * sums / np.sqrt(squares + 1.0)


def blank(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((1 << bits, CLASSES), np.float32), np.zeros((1 << bits, TOP_EACH), np.float32)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """``h, n`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        parts, size = [], 0
        for batch in batches:
            for _, _, data, bounds in K.slices(batch.column("text")):
                parts.append(tokens(data, bounds)[0])
                size += len(parts[-1])
                if size >= COUNT_WORDS:
                    yield out(parts)
                    parts, size = [], 0
        if parts:
            yield out(parts)

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def gather_counts(table: DataFrame) -> Counts:
    end = int(END.astype(np.int64))
    total, distinct, ends = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("h") == end, F.col("n"))), F.lit(0))).first()
    words = table.where(F.col("h") != end)
    # The smallest count that no more than HEAD words reach: a running sum over the distinct counts.
    reach = words.groupBy("n").agg(F.count("*").alias("words")).selectExpr("n", "sum(words) OVER (ORDER BY n DESC) AS words").where(F.col("words") <= HEAD)
    least = reach.agg(F.min("n")).first()[0]
    top = words.where(F.col("n") >= F.lit(least)).toArrow().sort_by([("n", "descending"), ("h", "ascending")])
    hashes, counts = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by_ending = words.groupBy(F.col("h").bitwiseAND(ENDINGS - 1).alias("e")).agg(F.sum("n"), F.sum((F.col("n") == 1).cast("long"))).collect()
    tokens_of, once = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for e, n, n1 in by_ending:
        tokens_of[e], once[e] = n, n1
    middle = np.bincount((hashes[:MIDDLE] & np.uint64(ENDINGS - 1)).astype(np.int64), weights=counts[:MIDDLE], minlength=ENDINGS)
    found = Counts(total, distinct, ends, hashes, counts, tokens_of - middle, once)
    return found


def train_tasks(total: int, bits: int) -> tuple[int, int]:
    """Shards of a round, and tasks that share them; each task writes one change of the size of the model."""
    shards = max(1, -(-total // (ROUNDS * SHARD_TOKENS)))
    model = sum(x.nbytes for x in blank(bits))
    return shards, min(shards, max(LEAST_TASKS, CHANGE_BYTES * total // (ROUNDS * model)))


def train(docs: DataFrame, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """The weights after one pass over the documents, in rounds of distributed gradient steps."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(counts)
    weights = blank(counts.bits)
    width = (1 << counts.bits) // BLOCKS
    # Dealt and ordered by hash, so that the model does not depend on how the table is cut.
    shards, tasks = train_tasks(counts.total, counts.bits)
    groups = math.isqrt(tasks - 1) + 1
    rows = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).alias("round"), F.xxhash64(F.lit(7), "doc_id", "text").alias("place"))

    for r in range(ROUNDS):
        current = context.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            known.prepare()

            def change(task: int, seen: int, sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
                packed = [zstandard.compress(b"".join(x[k * width : (k + 1) * width].tobytes() for x in sums), 1) for k in range(BLOCKS)]
                numbers = (np.arange(BLOCKS), np.full(BLOCKS, task % groups), np.full(BLOCKS, task), np.full(BLOCKS, seen))
                return pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(packed, pa.binary())], names=["block", "group", "task", "seen", "change"])

            def close() -> None:
                for x, new, old in zip(sums, (w, v), current.value):
                    x += (new - old) * np.float32(seen)

            shard, seen, task, total = None, 0, None, 0
            for batch in batches:
                numbers = batch.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else []
                for i, j in zip(cuts, cuts[1:]):
                    if numbers[i] != shard:
                        if shard is not None:
                            close()
                            total += seen
                        shard, seen = int(numbers[i]), 0
                        w, v = (x.copy() for x in current.value)
                        w2, v2 = np.zeros_like(w), np.zeros_like(v)
                    if shard % tasks != task:
                        if total:
                            yield change(task, total, sums)
                        task, total, sums = shard % tasks, 0, tuple(map(np.zeros_like, current.value))
                    for _, _, data, bounds in K.slices(batch.column("text").slice(i, j - i)):
                        h, starts = tokens(data, bounds)
                        rank, classes = known.class_of(h)
                        features = feature_rows(h, starts, known.bits)
                        seen += len(h)
                        for a in range(0, len(h), STEP):
                            part = slice(a, a + STEP)
                            own = [f[part] for f in features]
                            descend(w, w2, own, known.bias, classes[part])
                            top = np.flatnonzero((rank[part] >= 0) & (rank[part] < TOP))
                            if len(top):
                                c = classes[part][top]
                                descend(v, v2, word_rows([f[top] for f in own], c, known.bits), known.top_bias[c], rank[part][top] // TOP_CLASSES)
            if shard is not None:
                close()
                yield change(task, total + seen, sums)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list] = {}
            for batch in batches:
                for block, group, seen, change in zip(*(batch.column(c).to_pylist() for c in ("block", "group", "seen", "change"))):
                    x = np.frombuffer(zstandard.decompress(change), np.float32)
                    if (block, group) in sums:
                        sums[block, group][0] += seen
                        sums[block, group][1] += x
                    else:
                        sums[block, group] = [seen, x.astype(np.float64)]
            packed = [zstandard.compress(x.astype(np.float32).tobytes(), 1) for _, x in sums.values()]
            numbers = ([b for b, _ in sums], [g for _, g in sums], [n for n, _ in sums.values()])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(packed, pa.binary())], names=["block", "group", "seen", "change"])

        own = rows.where(F.col("round") == r).withColumn("shard", F.pmod("place", F.lit(shards))).withColumn("task", F.pmod("shard", F.lit(tasks)).cast("int"))
        # One partition for each task by its number, as two that meet by a hash would take twice as long.
        own = own.repartitionById(tasks, "task").sortWithinPartitions("task", "shard", "place").select("text", "shard")
        changes = own.mapInArrow(run, "block long, group long, task long, seen long, change binary")
        # Two levels of sums, so that no task reads the changes of all others; in one order, as sums depend on it.
        partial = changes.repartition("block", "group").sortWithinPartitions("block", "group", "task").drop("task").mapInArrow(add, "block long, group long, seen long, change binary")
        whole = partial.repartition(BLOCKS, "block").sortWithinPartitions("block", "group").select("block", F.lit(0).cast("long").alias("group"), "seen", "change")
        totals = whole.mapInArrow(add, "block long, group long, seen long, change binary").select("block", "seen", "change").collect()
        weights = tuple(x.copy() for x in weights)
        for block, seen, change in totals:
            x, at = np.frombuffer(zstandard.decompress(change), np.float32) / np.float32(seen), slice(block * width, (block + 1) * width)
            weights[0][at] += x[: width * CLASSES].reshape(width, CLASSES)
            weights[1][at] += x[width * CLASSES :].reshape(width, TOP_EACH)
    return weights


def score_texts(docs: DataFrame, table: DataFrame, counts: Counts, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared, model = context.broadcast(counts), context.broadcast(weights)
    floor = np.log10(counts.total + counts.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (w, v) = shared.value, model.value
        known.prepare()
        base_of = np.log10(known.counts + 1.0) - floor
        end_base, number = np.log10(known.ends + 1.0) - floor, TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, bounds in K.slices(batch.column("text")):
                h, starts = tokens(data, bounds)
                rank, classes = known.class_of(h)
                features = feature_rows(h, starts, known.bits)
                logs = np.zeros(len(h))
                for at in range(0, len(h), BATCH):
                    part = slice(at, at + BATCH)
                    own = [f[part] for f in features]
                    logs[part] = np.take_along_axis(log_softmax(w, own, known.bias), classes[part][:, None], axis=1)[:, 0]
                    top = np.flatnonzero((rank[part] >= 0) & (rank[part] < TOP))
                    if len(top):
                        c = classes[part][top]
                        logs[at + top] += np.take_along_axis(log_softmax(v, word_rows([f[top] for f in own], c, known.bits), known.top_bias[c]), (rank[part][top] // TOP_CLASSES)[:, None], axis=1)[:, 0]
                plain = rank >= TOP
                logs[plain] += known.share[rank[plain]]
                base = np.zeros(len(h))
                base[rank >= 0] = base_of[rank[rank >= 0]]
                base[h == END] = end_base

                n = b - a
                size = np.diff(starts)
                owner = np.repeat(np.arange(n), size)
                rare = np.flatnonzero((rank < 0) & (h != END))
                by = np.lexsort((h[rare], owner[rare]))
                rare_h, rare_doc = h[rare][by], owner[rare][by]
                begins = np.flatnonzero(np.concatenate([[True], (rare_h[1:] != rare_h[:-1]) | (rare_doc[1:] != rare_doc[:-1])])) if len(by) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([begins, [len(by)]]))
                rows, uid = np.arange(n), number + np.arange(n)
                number += n
                known_here = K.per_text((rank >= 0) | ((h == END) & (known.ends > 0)), starts)
                sums = [np.bincount(owner, weights=x, minlength=n) for x in (base, logs / np.log(10.0))]
                # A row for each text, which joins nothing of weight, then one for each of its rare words.
                many = len(begins)
                docs_of = pa.concat_arrays([batch.column("doc_id").slice(a, n), pa.nulls(many, pa.int64())])
                join = lambda x, y: pa.array(np.concatenate([x, y]))
                yield pa.RecordBatch.from_arrays(
                    [
                        join(uid, uid[rare_doc[begins]]),
                        docs_of,
                        join(K.mix(uid.astype(np.uint64)).view(np.int64), rare_h[begins].view(np.int64)),
                        join(np.zeros(n, np.int64), times),
                        join(size, np.zeros(many, np.int64)),
                        join(known_here, np.zeros(many, np.int64)),
                        *(join(x, np.zeros(many)) for x in sums),
                    ],
                    names=["uid", "doc_id", "h", "times", "n_tokens", "n_known", "base", "model"],
                )

    schema = "uid long, doc_id long, h long, times long, n_tokens long, n_known long, base double, model double"
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    room = counts.rest_room()
    whole = np.maximum(counts.rest_tokens + room, 1)
    by_ending = lambda x: F.element_at(F.array(*map(F.lit, map(float, x))), (F.col("h").bitwiseAND(ENDINGS - 1) + 1).cast("int"))
    joined = parts.join(table, "h", "left")
    c = F.coalesce("n", F.lit(0))
    return (
        joined.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.col("times") * (F.log10(c + 1.0) - float(floor))).alias("base_score"),
            F.sum(F.col("model") + F.col("times") * F.log10(F.when(c > 0, c).otherwise(by_ending(room)) / by_ending(whole))).alias("score"),
        )
        .select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), "base_score", "score")
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    learnt = docs.where(~held_out())
    table = stored(token_counts(learnt), "lm-counts")
    counts = gather_counts(table)
    return score_texts(docs, table, counts, train(learnt, counts))
