"""What the operators share: words, intermediate tables, document keys."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts have it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, with its file system: that of the checkpoints, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/textloom-shared"
    where = spark._jvm.org.apache.hadoop.fs.Path(named)
    path = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    # Hadoop writes file:/x where others write file:///x.
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


#: Paths in the shared folder by who asked for them; None: for the caller to keep.
_paths: dict[str | None, list[str]] = defaultdict(list)
_owner: list[str | None] = [None]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"
    _paths[_owner[-1]].append(path)
    return path


@contextmanager
def owner(name: str) -> Iterator[None]:
    """Marks what is written meanwhile, so that ``remove`` finds it."""
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def remove(spark: SparkSession, name: str) -> None:
    """Deletes the tables that were written for an owner; nothing may still read them."""
    for path in _paths.pop(name, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    """Deletes at the driver's end what callers have kept until then."""
    for path in [p for paths in _paths.values() for p in paths]:
        with contextlib.suppress(Exception):
            files, base = pyarrow.fs.FileSystem.from_uri(path)
            files.delete_dir(base)


def read_part(path: str, part: str = "", columns: list[str] | None = None) -> pa.Table | None:
    """Rows of a stored table, or of one of its partitions, read by a task; None for a partition without rows.

    A table that cannot be seen from here is an error, never an empty result.
    """
    files, base = pyarrow.fs.FileSystem.from_uri(path)
    if part and files.get_file_info(f"{base}/{part}").type == pyarrow.fs.FileType.NotFound:
        if files.get_file_info(base).type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(f"no table at {path}: is the folder shared by all executors?")
        return None
    return pyarrow.dataset.dataset(f"{base}/{part}".rstrip("/"), filesystem=files, format="parquet", exclude_invalid_files=False).to_table(columns=columns)


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """The table, written to the shared folder and read back: cuts lineage and outlives executors.

    ``small``: an eighth of the shuffle partitions is enough for its rows.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, name: str) -> str:
    """Writes a table to the shared folder; returns its path, for ``read_part``."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose keys have the smallest hashes.

    Rows that cannot be among them are left out before the sort, or every task
    would send n rows to the driver.
    """
    least, whole = F.pmod(F.xxhash64(key), F.lit(1 << 62)), rows.count()
    likely = rows.where(least < int(min(1.0, 1.5 * n / max(whole, 1)) * (1 << 62))) if n >= 1000 else rows
    return likely.orderBy(least, *rows.columns).limit(n)


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
