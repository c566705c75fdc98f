"""Mixing sources to target weights.

Each source's documents stand on one axis of words, in a fixed pseudorandom
order, which is cut into blocks of one length.  The length is a power of two up
to ``MOST_WORDS`` that leaves a source at least ``LEAST_BLOCKS`` blocks where
it can, so small sources meet their targets as closely as large ones.

The mix has as many slots of a source as its target needs blocks: those of its
whole passes, and of the last pass in proportion.  All slots of the mix are put
in one pseudorandom order, and every ``SHARD_SLOTS`` of them make an output
shard, so a shard's counts of sources are a multinomial draw, given that the
draws of all shards add up to the targets.  (Independent draws would miss a
source's target by one over the square root of its slots.)

Slot ``q`` of a source is in pass ``q // blocks`` and takes the block that a
keyed permutation of the source's block numbers (swap-or-not rounds, one set of
keys per source and pass) gives for ``q % blocks``.  Slots and blocks meet in
one equi-join on source and block.  Slots are made in chunks that are dealt to
all tasks, and positions on the axis are sums over three levels of buckets, so
one source may hold all words.

A pass takes every block once and no source gets more than three passes, so
no document is taken more than three times its size.  Everything derives from
row values and integer arithmetic: reruns agree.

Defined results: null and empty texts have size 0 and ``taken`` 0; a null
source is a source of its own, sorted last; equal rows are separate documents;
an empty table gives an empty result; a table without words has targets of 0;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, stored

SHARD_SLOTS = 1024
ROUNDS = 12
MAX_PASSES = 3
MOST_WORDS, LEAST_BLOCKS = 2048, 4096
#: Slots that a row of the table of chunks stands for.
CHUNK_SLOTS = 1024
#: Rows that one task sorts on average, and sorted buckets that one task adds up.
BUCKET_ROWS, SUM_BUCKETS = 1_000, 1_000
KEY_RANGE = 1 << 32


def number(text: str) -> str:
    """A number below 2**32 from a text expression."""
    return f"CAST(conv(substr(md5({text}), 1, 8), 16, 10) AS BIGINT)"


def order_key() -> str:
    """Where a document stands among those of its source."""
    return number("concat(coalesce(CAST(doc_id AS STRING), ''), ':', coalesce(text, ''))")


def round_keys(name: str) -> str:
    """The keys of a permutation that an expression names."""
    return f"transform(sequence(1, {ROUNDS}), r -> {number(f'concat({name}, {chr(39)}:{chr(39)}, r)')})"


def permuted(x: str, n: str, keys: str) -> str:
    """Where the permutation of 0..n-1 with the keys puts x.

    A swap-or-not round pairs each position with its mirror image around a key and
    swaps the pair or not by a hash that both have in common.
    """
    mirror = f"(k % {n} - x + {n}) % {n}"
    return f"aggregate({keys}, {x}, (x, k) -> transform(array({mirror}), m -> CASE WHEN md5(concat(greatest(x, m), ':', k)) >= '8' THEN m ELSE x END)[0])"


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, sidx, source_size, target`` per source; sidx counts sources by code point, null last.

    Caps are filled in the order of cap by weight: a source is full exactly if its cap is
    at most its weight's share of what the fuller sources before it leave.
    The table has one row per source, so its windows need no partitioning.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    ranked = by.selectExpr("*", "row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sidx").selectExpr("*", "sidx % 3 + 1 AS weight", f"{MAX_PASSES} * source_size AS cap")
    filled = ranked.selectExpr(
        "*",
        "sum(source_size) OVER () AS total",
        "sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight",
        "sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_words",
    ).selectExpr("*", "CAST(open_words AS DOUBLE) / open_weight AS level")
    first_open = "min(CASE WHEN cap > weight * level THEN struct(cap / CAST(weight AS DOUBLE) AS r, sidx, level) END) OVER ()"
    return filled.selectExpr("*", f"{first_open} AS f").selectExpr(
        "source", "sidx", "source_size", "CAST(CASE WHEN f IS NULL OR struct(cap / CAST(weight AS DOUBLE) AS r, sidx) < struct(f.r, f.sidx) THEN cap ELSE weight * f.level END AS DOUBLE) AS target"
    )


def with_blocks(targets: DataFrame) -> DataFrame:
    """Adds ``words`` (of a block), ``blocks``, ``slots``, and the mix's slots ``before`` those of the source and in ``every`` source."""
    lengths = ", ".join(str(1 << k) for k in range(MOST_WORDS.bit_length()))
    sized = targets.selectExpr("*", f"CAST(array_max(filter(array({lengths}), w -> w = 1 OR w * {LEAST_BLOCKS}L <= source_size)) AS BIGINT) AS words")
    cut = sized.selectExpr("*", "(source_size + words - 1) DIV words AS blocks", "coalesce(CAST(floor(try_divide(target, source_size)) AS BIGINT), 0L) AS passes")
    rest = "CAST(floor(coalesce(try_divide(target - passes * source_size, source_size), 0D) * blocks + 0.5D) AS BIGINT)"
    filled = cut.selectExpr("*", f"least({MAX_PASSES} * blocks, passes * blocks + {rest}) AS slots").drop("passes")
    return filled.selectExpr("*", "coalesce(sum(slots) OVER (ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before", "sum(slots) OVER () AS every")


def draw_slots(sources: DataFrame) -> DataFrame:
    """``shard, place, sidx, q, pass, block`` of every slot of the mix: block ``block`` of source ``sidx`` is number ``place`` of the shard."""
    # By number, as Spark would join the few and small rows of chunks to one partition.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = sources.where("slots > 0").selectExpr("sidx", "blocks", "slots", "before", "every", f"explode(sequence(0L, (slots - 1) DIV {CHUNK_SLOTS})) AS chunk").repartition(tasks, "sidx", "chunk")
    of_pass = round_keys("concat(sidx, ':', pass)")
    keyed = chunks.selectExpr("*", f"transform(sequence(0, {MAX_PASSES - 1}), pass -> {of_pass}) AS keys", f"{round_keys(chr(39) + 'all' + chr(39))} AS all_keys")
    slots = keyed.selectExpr("sidx", "blocks", "before", "every", "keys", "all_keys", f"explode(sequence(chunk * {CHUNK_SLOTS}, least(slots, (chunk + 1) * {CHUNK_SLOTS}) - 1)) AS q")
    drawn = slots.selectExpr("sidx", "q", "q DIV blocks AS pass", f"{permuted('q % blocks', 'blocks', 'keys[CAST(q DIV blocks AS INT)]')} AS block", f"{permuted('before + q', 'every', 'all_keys')} AS at")
    return drawn.selectExpr(f"at DIV {SHARD_SLOTS} AS shard", f"at % {SHARD_SLOTS} AS place", "sidx", "q", "pass", "block")


def place_documents(sizes: DataFrame, rows: int) -> DataFrame:
    """Adds ``start``, each document's place on its source's axis of words."""
    width = KEY_RANGE // max(1, rows // BUCKET_ROWS) + 1
    named = sizes.selectExpr("*", f"b DIV {width} AS bucket").selectExpr("*", f"bucket DIV {SUM_BUCKETS} AS zone")
    in_bucket = stored(named.groupBy("sidx", "zone", "bucket").agg(F.sum("size").alias("n")), "mix-buckets", small=True)
    zones = in_bucket.groupBy("sidx", "zone").agg(F.sum("n").alias("n")).selectExpr("sidx", "zone", "sum(n) OVER (PARTITION BY sidx ORDER BY zone) - n AS before_zone")
    buckets = in_bucket.selectExpr("*", "sum(n) OVER (PARTITION BY sidx, zone ORDER BY bucket) - n AS before_bucket").join(zones, ["sidx", "zone"]).selectExpr("sidx", "bucket", "before_zone + before_bucket AS before")
    inside = named.selectExpr("*", "sum(size) OVER (PARTITION BY sidx, bucket ORDER BY b, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS inside")
    return inside.join(buckets, ["sidx", "bucket"]).selectExpr("*", "before + inside AS start").drop("bucket", "zone", "before", "inside")


def mix_sources(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, shards, source``; shards: how many take a part of it."""
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("size"), F.expr(order_key()).alias("b")), "mix-sizes")
    sources = stored(with_blocks(source_targets(sizes)), "mix-sources", small=True)
    named = sizes.join(sources.select(F.col("source").alias("of"), "sidx", "source_size", "target", "words"), F.expr("source <=> of")).drop("of")
    placed = place_documents(named.where("size > 0"), sizes.count())

    taken = draw_slots(sources).groupBy("sidx", "block").agg(F.count("*").alias("times"), F.collect_list("shard").alias("shard_list"))
    pieces = placed.selectExpr("*", "explode(sequence(start DIV words, (start + size - 1) DIV words)) AS block").selectExpr("*", "least(start + size, (block + 1) * words) - greatest(start, block * words) AS part")
    out = ["doc_id", "size", "source_size", "target"]
    full = (
        pieces.join(taken, ["sidx", "block"], "left")
        .groupBy(*out, "source", "sidx", "start")
        .agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list("shard_list")))).cast("long").alias("shards"))
        .select(*out, "taken", "shards", "source")
    )
    return full.unionByName(named.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("shards"), "source"))
