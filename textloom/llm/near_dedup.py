"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

A document's set holds its distinct shingles of ``shingle`` words (the whole
sequence if it has fewer words); sets link from ``percent`` of Jaccard
similarity on.  The query takes three words and 85, the pipeline five and 80.  Documents with equal sets form a class, so copies cost
one row each and only one member of a class is compared.

SuperMinHash: every shingle visits all signature slots once, in the order of
its own permutation, with rank ``j`` plus a uniform number at its j-th visit;
a slot keeps the smallest value.  Ranks of one shingle are thus correlated over
slots, which lowers the variance, and visits stop as soon as every slot of a
document holds a value below the next rank.

Bands of the signature are buckets.  A bucket is not expanded to pairs: its
members are compared with one centre, the member whose buckets are largest in
total, and links are confirmed on the full sets.  Union-find over the links
gives components.  Where a bucket still holds more than one component, its
members of different components are compared too, where what they have in
common in their differences from a core allows a link, so nothing that a bucket
suggests is left open, and no bucket is expanded to pairs.

Defined results: null, empty and wordless texts have an empty set, are linked
with nothing and stand alone; rows with equal doc_id and text are one document
with equal results; different texts under one doc_id are documents of their
own; rows without doc_id get a null component and stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import stored

SHINGLE = 3
PERCENT = 85
SLOTS = 64
#: Slots of a band.
BAND_SLOTS = 4
#: Chance that two sets just similar enough share no band.
MISSED = 1e-5
#: Members of a centre whose majority makes its core.
CORE_MEMBERS = 15
#: Members meet at subsets of up to so many shingles, taken from no more than so many.
LEVELS, MOST_ITEMS = 4, 8
#: Members at the keys are compared with one of them first if there are so many pairs for each.
STAR_FIRST = 8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES, _WORD, _SHINGLE = K.byte_codes(81), K.Roller(82), K.Roller(83)


def bands_for(percent: int) -> int:
    """As many bands as keep the chance of a miss; 16 at 85 percent."""
    return math.ceil(math.log(MISSED) / math.log(1 - (min(percent, 99) / 100) ** BAND_SLOTS))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their numbers."""
    texts = K.Texts(LOWER[data], bounds)
    prefix = _SHINGLE.prefix(texts.word_hashes(_WORD, _CODES))
    sets = []
    for a, b in zip(texts.first[:-1], texts.first[1:]):
        at = np.arange(a, max(b - shingle, a) + 1) if b > a else np.zeros(0, np.int64)
        sets.append(np.unique(_SHINGLE.ranges(prefix, at, np.minimum(at + shingle, b)) + np.uint64(min(b - a, shingle))))
    return np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))


def superminhash(sets: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures, a row of ``slots`` values for each set: rank in the high byte, then 24 uniform bits."""
    n = len(counts)
    values = np.full((n, slots), 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(n), counts)
    order = None  # each shingle's permutation, shuffled as far as it has come
    for j in range(slots):
        if not len(sets):
            break
        draw = K.mix(sets + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
        pick = j + (draw >> np.uint64(32)) % np.uint64(slots - j)
        pick = pick.astype(np.int64)
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(sets), 1))
        rows = np.arange(len(sets))
        slot = order[rows, pick].astype(np.int64)
        order[rows, pick] = order[rows, j]
        np.minimum.at(values.reshape(-1), owner * slots + slot, (np.uint32(j) << np.uint32(24)) | (draw & np.uint64(0xFFFFFF)).astype(np.uint32))
        open_docs = values.max(axis=1) >= np.uint32(min((j + 1) << 24, 0xFFFFFFFF))
        left = open_docs[owner]
        if not left.all():
            sets, owner, order = sets[left], owner[left], order[left]
    return values


def signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, tkey`` (a hash of the text), ``n_shingles, d1, d2`` (a digest of the set) and the ``bands`` of each document."""
    n_bands = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in K.slices(batch.column("text")):
                sets, counts = shingle_sets(data, bounds, shingle)
                ends = np.concatenate([[0], np.cumsum(counts)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(sets + np.uint64(s)))]) for s in (1, 2)]
                digests = [K.mix(x[ends[1:]] - x[ends[:-1]] + counts.astype(np.uint64)).view(np.int64) for x in sums]
                values = superminhash(sets, counts, n_bands * BAND_SLOTS).astype(np.uint64).reshape(-1, n_bands, BAND_SLOTS)
                bands = np.zeros(values.shape[:2], np.uint64)
                for r in range(values.shape[2]):
                    bands = K.mix(bands * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r] + np.uint64(r))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * n_bands), pa.array(bands.reshape(-1).view(np.int64)))
                keys = [batch.column(c).slice(a, b - a) for c in ("doc_id", "tkey")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(counts), *map(pa.array, digests), lists], names=["doc_id", "tkey", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, "doc_id long, tkey long, n_shingles long, d1 long, d2 long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets are similar enough; ``texts``: ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last, center = None, None
            names, b_rows = batch.column("a").to_numpy(), batch.column("text_b")
            for i, j, data, bounds in K.slices(b_rows):
                sets, counts = shingle_sets(data, bounds, shingle)
                ends = np.concatenate([[0], np.cumsum(counts)])
                for k in range(i, j):
                    if names[k] != last:
                        last = names[k]
                        center = np.concatenate([shingle_sets(*x[2:], shingle)[0] for x in K.slices(batch.column("text_a").slice(k, 1))])
                    own = sets[ends[k - i] : ends[k - i + 1]]
                    both = np.count_nonzero(K.in_sorted(own, center))
                    keep[k] = 100 * both >= percent * (len(own) + len(center) - both)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _forest(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: union-find over each partition, by chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = parent[p]
                    x = parent[x]
                return x

            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            links = [(find(x), x) for x in list(parent) if find(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes of the edges ``a, b``: the smallest node of each one's component.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest node it knows, until nothing changes; rounds grow with the logarithm of
    the longest path.
    """
    edges, before = stored(_forest(edges).distinct(), "near-edges", small=True), None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        larger = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        least = larger.groupBy("b").agg(F.min("a").alias("m"))
        smaller = larger.join(least, "b")
        edges = stored(smaller.select(F.col("m").alias("a"), F.col("a").alias("b")).union(smaller.select(F.col("m").alias("a"), "b")).where("a != b").distinct(), "near-edges", small=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
        before = now


def _cores(samples: DataFrame, shingle: int) -> DataFrame:
    """``a, core``: the shingles that most of a centre's sampled members have; ``samples``: ``a, texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores = []
            for texts in batch.column("texts"):
                sets = [shingle_sets(*x[2:], shingle)[0] for x in K.slices(texts.values, 1)]
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                cores.append(found[2 * times > len(sets)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(cores, pa.list_(pa.int64()))], names=["a", "core"])

    return samples.mapInArrow(run, "a long, core array<long>")


def _differences(members: DataFrame, shingle: int) -> DataFrame:
    """``a, node, label, own, diff, bits``: the size of a member's set, the shingles that it or its centre's core has alone, and their parities.

    Of 256 numbers that shingles may get, ``bits`` marks those that an odd count of the differences has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores, owns, diffs, bits = batch.column("core"), [], [], []
            for i, j, data, bounds in K.slices(batch.column("text")):
                sets, counts = shingle_sets(data, bounds, shingle)
                ends = np.concatenate([[0], np.cumsum(counts)])
                for k in range(i, j):
                    own, core = sets[ends[k - i] : ends[k - i + 1]], np.sort(cores[k].values.to_numpy().view(np.uint64))
                    owns.append(len(own))
                    diff = np.concatenate([own[~K.in_sorted(own, core)], core[~K.in_sorted(core, own)]])
                    diffs.append(diff.view(np.int64))
                    odd = np.bincount((K.mix(diff) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            names = ["a", "node", "label", "own", "diff", "bits"]
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (diffs, bits))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(owns, pa.int64()), *lists], names=names)

    return members.select("a", "node", "label", "core", "text").mapInArrow(run, "a long, node long, label long, own long, diff array<long>, bits array<long>")


def _subsets(items: str, k: int) -> str:
    """An expression for the hashes of all k items of an array of distinct numbers."""
    names = [f"i{n}" for n in range(k)]
    out = f"array(xxhash64({', '.join(f'{items}[{x}]' for x in names)}))"
    for n in reversed(range(k)):
        after = f"x -> x > {names[n - 1]}" if n else "x -> true"
        out = f"flatten(transform(filter(sequence(0, size({items}) - 1), {after}), {names[n]} -> {out}))"
    return out


def _meeting_places(described: DataFrame, percent: int) -> DataFrame:
    """``a, k, key, node, label, slack, d, bits, level, rest, leads``: keys of which two members that may be similar enough share one.

    With d shingles of difference to the core, o of them in common, and slack =
    (100 - percent) * own - (100 + percent) * d, two sets are similar enough exactly
    if slack + slack + 2 * (100 + percent) * o >= 0.  So each member has to share at
    least ``base`` of its differences with any partner (``best``: the most slack of
    one), and two members at least as many as the one with more slack needs for its
    like (``own_need``).  Sets that
    share o items share k of the d - o + k rarest ones of either (prefix filtering), so
    the subsets of k of these are keys; k is the smaller one of two members' levels.
    A subset of the needed size is common among similar members alone.

    ``rest``: as many differences as two members can share if this is the rarest key
    they have in common.  ``leads``: they are enough for a partner of no more slack,
    as they are at the rarest common key of members similar enough.
    """
    both = 2 * (100 + percent)
    outside = described.select("a", "node", "label", F.explode("diff").alias("s"))
    common = stored(outside.groupBy("a", "s").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x != y").select("a", "s", "n"), "near-common", small=True)
    rarest = outside.join(common, ["a", "s"]).groupBy("a", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("items"))
    needs = described.select("a", "node", "label", "slack", "best", "widest", "bits", F.size("diff").cast("long").alias("d")).join(rarest, ["a", "node"])
    # As a partner has at least the shared shingles of difference itself, its slack is at most (100 - percent) * widest - (100 + percent) * o.
    base = f"greatest(1L, CAST(ceil(-(slack + best) / {both}D) AS BIGINT), CAST(ceil(-(slack + {100 - percent} * widest) / {both // 2}D) AS BIGINT))"
    needs = needs.selectExpr("*", f"{base} AS base").selectExpr("*", f"greatest(base, CAST(ceil(-slack / {both // 2}D) AS BIGINT)) AS own_need")
    width = lambda k: f"least(size(items), size(items) - greatest({k}, base) + {k})"
    allowed = " + ".join(f"CAST(own_need >= {k} AND {width(k)} BETWEEN {k} AND {MOST_ITEMS} AS INT)" for k in range(2, LEVELS + 1))
    levelled = needs.selectExpr("*", f"1 + {allowed} AS level")
    one = f"transform(slice(items, 1, CAST(greatest(0, {width(1)}) AS INT)), (s, i) -> named_struct('k', 1, 'key', xxhash64(s), 'rest', size(items) - i))"
    more = (f"CASE WHEN level >= {k} AND {width(k)} >= {k} THEN transform({_subsets(f'p{k}', k)}, h -> named_struct('k', {k}, 'key', h, 'rest', size(items))) ELSE CAST(array() AS array<struct<k: int, key: bigint, rest: int>>) END" for k in range(2, LEVELS + 1))
    prefixes = levelled.selectExpr("*", *(f"array_sort(slice(items, 1, CAST(greatest(0, {width(k)}) AS INT))) AS p{k}" for k in range(2, LEVELS + 1)))
    placed = prefixes.selectExpr("a", "node", "label", "slack", "d", "bits", "level", "own_need", f"explode(concat({', '.join([one, *more])})) AS place")
    return placed.selectExpr("a", "place.k AS k", "place.key AS key", "node", "label", "slack", "d", "bits", "level", "place.rest AS rest", "place.rest >= own_need AS leads")


def open_links(shared: DataFrame, centers: DataFrame, labels: DataFrame, texts: DataFrame, links: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """``a, b``: links between members of different components that share a bucket, as many as join all components that links join.

    Pairs are not formed within buckets, where a large group of copies would give
    its square.  The members of a centre are described by their differences from a
    core, and what two members' differences have in common tells exactly whether
    they are similar enough.  Members that need nothing in common are linked with
    the one that has most slack.  All others meet at keys that similar members
    share.  Where many meet at one key, they are compared with one of them first,
    and only those that this leaves in different components form pairs.
    Any core is right; a good one, from the majority of a few members, leaves few keys.
    """
    named = stored(shared.join(labels, "node", "left").select("band", "h", "node", F.coalesce("label", "node").alias("label")), "near-named", small=True)
    split = named.groupBy("band", "h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("band", "h")
    members = stored(named.join(split, ["band", "h"]).join(centers.select("band", "h", "a"), ["band", "h"]).select("a", "node", "label").distinct(), "near-open", small=True)
    if members.isEmpty():
        return None
    few = members.selectExpr("a", "node", "row_number() OVER (PARTITION BY a ORDER BY xxhash64(node), node) AS r").where(f"r <= {CORE_MEMBERS}")
    cores = stored(_cores(few.join(texts, "node").groupBy("a").agg(F.collect_list("text").alias("texts")), shingle), "near-cores", small=True)
    slack = f"{100 - percent} * own - {100 + percent} * size(diff)"
    described = stored(_differences(members.join(texts, "node").join(cores, "a"), shingle).selectExpr("*", f"{slack} AS slack"), "near-differences", small=True)

    # Those within reach of the top, whatever they have in common, are one component with it; the others remain to be linked.
    top = stored(described.groupBy("a").agg(F.max(F.struct("slack", "node", "label")).alias("top"), F.max("own").alias("widest")), "near-tops", small=True)
    placed = described.join(top, "a").withColumn("within", F.expr("slack + top.slack >= 0"))
    sure = placed.where("within AND node != top.node").select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    beyond = stored(placed.where("NOT within").groupBy("a").agg(F.max("slack").alias("beyond")), "near-beyond", small=True)
    own_label, best = F.expr("CASE WHEN within THEN top.label ELSE label END"), F.expr("CASE WHEN within THEN beyond ELSE top.slack END")
    described = stored(placed.join(beyond, "a").select("a", "node", own_label.alias("label"), "own", "diff", "bits", "slack", best.alias("best"), "widest"), "near-described", small=True)

    def tested(pairs: DataFrame) -> DataFrame:
        of = lambda n: described.select(F.col("a").alias("c"), F.col("node").alias(n), F.col("slack").alias(f"slack_{n}"), F.col("diff").alias(f"diff_{n}"))
        both = pairs.distinct().join(of("a"), ["c", "a"]).join(of("b"), ["c", "b"])
        return both.where(f"slack_a + slack_b + {2 * (100 + percent)} * size(array_intersect(diff_a, diff_b)) >= 0").select("a", "b")

    def live(rows: DataFrame) -> DataFrame:
        """The keys at which pairs have to be formed, with how many members and the one with most slack."""
        groups = rows.groupBy("a", "k", "key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.col("level") == F.col("k")).alias("home"), F.max("leads").alias("led"), F.count("*").alias("n"), F.max(F.struct("slack", "node")).alias("top"))
        return stored(groups.where("x != y AND home AND led").select("a", "k", "key", "n", F.col("top.node").alias("top")), "near-keys", small=True)

    keyed = stored(_meeting_places(described, percent), "near-places", small=True)
    keys = live(keyed)
    met = stored(keyed.join(keys.select("a", "k", "key", "top"), ["a", "k", "key"]), "near-met", small=True)
    pairs, rows = keys.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = [sure]
    if pairs > STAR_FIRST * rows:
        star = met.where("node != top").select(F.col("a").alias("c"), F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b"))
        found = [stored(sure.union(tested(star)), "near-stars", small=True)]
        now = components(links.union(found[0]))
        # Components only merge, so keys without open pairs stay so: rows at the others alone get new labels, once.
        met = stored(met.drop("label").join(now, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-met", small=True)
        met = met.join(live(met).select("a", "k", "key"), ["a", "k", "key"])
    side = lambda rows, n: rows.select(F.col("a").alias("c"), "k", "key", F.col("node").alias(n), *(F.col(x).alias(f"{x}_{n}") for x in ("label", "slack", "d", "bits", "level", "rest")))
    # What one of them has alone is at least as much as their parities differ.
    apart = " + ".join(f"bit_count(bits_a[{x}] ^ bits_b[{x}])" for x in range(4))
    may = f"""(slack_a > slack_b OR slack_a = slack_b AND a < b) AND label_a != label_b AND (level_a = k OR level_b = k)
        AND slack_a + slack_b + {2 * (100 + percent)} * least(rest_a, rest_b) >= 0 AND slack_a + slack_b + {100 + percent} * (d_a + d_b - ({apart})) >= 0"""
    close = side(met.where("leads"), "a").join(side(met, "b"), ["c", "k", "key"]).where(may)
    found.append(tested(close.select("c", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    return stored(found[0].union(found[1]), "near-more", small=True)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, class_id`` (the smallest doc_id with the same set)."""
    return _grouped(docs, shingle, percent).drop("tkey")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    sigs = stored(signatures(docs, shingle, percent), "near-signatures")
    grouped = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "tkey")).alias("rep"), F.first("bands").alias("bands"))
    # Numbered, as different texts can have one doc_id.
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n_shingles", "rep.doc_id", "rep.tkey", "bands"), "near-classes")
    rows = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "h"))
    sizes = stored(rows.groupBy("band", "h").agg(F.count("*").alias("members")).where("members > 1"), "near-sizes", small=True)
    shared = stored(rows.join(sizes, ["band", "h"]), "near-buckets")

    weight = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    members = shared.join(weight, "node")
    centers = stored(members.groupBy("band", "h").agg(F.max(F.struct("weight", -F.col("node"), "n_shingles")).alias("c")).select("band", "h", F.expr("-c.col2").alias("a"), F.col("c.n_shingles").alias("n_a")), "near-centers", small=True)
    similar_size = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    stars = shared.withColumnRenamed("n_shingles", "n_b").withColumnRenamed("node", "b").join(centers, ["band", "h"]).where("a != b").where(similar_size).select("a", "b").distinct()

    wanted = shared.select("node").distinct().join(classes.select("node", F.col("doc_id").alias("__doc"), F.col("tkey").alias("__key")), "node")
    keyed = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__key"), "text")
    texts = stored(keyed.join(wanted, ["__doc", "__key"]).dropDuplicates(["__doc", "__key"]).select("node", "text"), "near-texts")
    links = stored(confirmed(stars, texts, shingle, percent), "near-links", small=True)
    labels = components(links)

    more = open_links(shared, centers, labels, texts, links, shingle, percent)
    if more is not None and not more.isEmpty():
        labels = components(links.union(more))

    named = classes.select("d1", "d2", "n_shingles", "node", "doc_id").join(labels, "node", "left").select("d1", "d2", "n_shingles", F.col("doc_id").alias("class_id"), F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    nodes = stored(named.join(least, "label").drop("label"), "near-nodes")
    out = sigs.drop("bands").join(nodes, ["d1", "d2", "n_shingles"], "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return out.select("doc_id", "tkey", "n_shingles", own("component_id").alias("component_id"), F.coalesce(F.col("doc_id") == own("component_id"), F.lit(True)).alias("kept"), own("class_id").alias("class_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without those that a smaller doc_id of their group stands for.

    Equal rows (doc_id and text) count once; of different texts of one group under its
    smallest doc_id all stay.
    """
    gone = _grouped(docs, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("__near_doc"), F.col("tkey").alias("__near_key")).distinct()
    keyed = docs.withColumn("__near_own", F.xxhash64("text"))
    left = keyed.join(gone, F.expr("doc_id = __near_doc AND __near_own = __near_key"), "left_anti")
    once = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "__near_own"])
    return left.where("doc_id IS NULL").unionByName(once).select(*docs.columns)
