"""Variable-byte codes and gaps of postings.

Seven bits a byte, most significant group first; the last byte carries the
high bit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Postings of a term are worked on in blocks of two to the power of this.
BLOCK_BITS = 16


def encode(value: int) -> bytes:
    if value < 0:
        raise ValueError("only numbers from 0 on can be encoded")
    groups = [value & 0x7F | 0x80]
    while value := value >> 7:
        groups.append(value & 0x7F)
    return bytes(reversed(groups))


def decode(data: bytes) -> list[int]:
    out, value = [], 0
    for byte in data:
        value = value << 7 | byte & 0x7F
        if byte & 0x80:
            out.append(value)
            value = 0
    return out


def int_to_bytes(value: int) -> bytes:
    return value.to_bytes(4, "big", signed=True)


def bytes_to_int(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


@F.pandas_udf(T.BinaryType())
def vbyte_encode(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else b"".join(map(encode, map(int, x))))


@F.pandas_udf(T.ArrayType(T.LongType()))
def vbyte_decode(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else decode(x))


def vbyte_length(v: str | Column) -> Column:
    """Bytes of the code, as an expression."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3).when(v < 1 << 28, 4).otherwise(5).cast("long")


def position_gaps(positions: str | Column = "positions") -> Column:
    p = F.col(positions) if isinstance(positions, str) else positions
    return F.transform(p, lambda x, i: x - F.when(i > 0, F.element_at(p, i)).otherwise(F.lit(0)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def gaps_to_positions(gaps: pd.Series) -> pd.Series:
    return gaps.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int32))


def _blocks(rows: DataFrame, order: str, figures: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_block``, a part of their term by ``order``, as a stop word's postings should be no single task; and figures of the blocks."""
    blocked = rows.withColumn("_block", F.shiftright(order, BLOCK_BITS))
    return blocked, blocked.groupBy("term", "_block").agg(*figures)


def delta_postings(postings: DataFrame) -> DataFrame:
    """``term, ordinal, doc_id, doc_gap, tf, gaps``: the first document of a term as it is, then differences."""
    rows, blocks = _blocks(postings, "doc_id", [F.max("doc_id").alias("_last"), F.count("*").alias("_n")])
    by_block = Window.partitionBy("term").orderBy("_block")
    sums = F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    blocks = blocks.select("term", "_block", F.lag("_last", 1, 0).over(by_block).alias("_before"), sums.alias("_done"))
    order = Window.partitionBy("term", "_block").orderBy("doc_id")
    own = rows.select("*", F.row_number().over(order).alias("_own"), F.lag("doc_id").over(order).alias("_prev")).join(blocks, ["term", "_block"])
    gap = F.col("doc_id") - F.coalesce("_prev", "_before")
    return own.select("term", (F.col("_done") + F.col("_own")).alias("ordinal"), "doc_id", gap.alias("doc_gap"), "tf", position_gaps().alias("gaps"))


def undelta_postings(coded: DataFrame, order: str = "ordinal") -> DataFrame:
    """The postings of coded ones whose column ``order`` numbers those of a term."""
    rows, blocks = _blocks(coded, order, [F.sum("doc_gap").alias("_gaps")])
    blocks = blocks.select("term", "_block", (F.sum("_gaps").over(Window.partitionBy("term").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_gaps")).alias("_before"))
    upto = Window.partitionBy("term", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("term", "_block", "tf", "gaps", F.sum("doc_gap").over(upto).alias("_upto")).join(blocks, ["term", "_block"])
    return own.select("term", (F.col("_before") + F.col("_upto")).alias("doc_id"), "tf", gaps_to_positions("gaps").alias("positions"))


def encoded_sizes(postings: DataFrame) -> DataFrame:
    """Bytes of the index in four-byte numbers without and with positions, and delta and variable-byte coded."""
    coded = delta_postings(postings)
    in_gaps = F.aggregate("gaps", F.lit(0).cast("long"), lambda s, x: s + vbyte_length(x))
    return coded.agg(
        (F.count("*") * 4).alias("doconly_bytes"),
        (F.sum(F.col("tf") + 2) * 4).alias("positional_bytes"),
        F.sum(vbyte_length("doc_gap") + vbyte_length("tf") + in_gaps).alias("compressed_bytes"),
    )
