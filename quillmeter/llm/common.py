"""What the operators of this folder share: tables in the cluster's shared folder, size-checked broadcasts, the word rule."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.tables import shared_dir, small_side  # noqa: F401

#: What separates words, after A-Z are lower-cased; everything else belongs to a word.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words of a lower-cased text, by the characters that are in them: Java matches this several times as fast.
LOWERED_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(tables.new_path(spark, name))
    return _made[-1]


def stored(df: DataFrame, name: str = "table", files: int | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage ends here and survives lost executors.

    files: at most so many, for tables whose size other things bound, instead of one for each shuffle partition.
    """
    path = new_path(df.sparkSession, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the tables made meanwhile, but for those whose paths are in the list that it gives."""
    first, kept = len(_made), []
    try:
        yield kept
    finally:
        for path in [p for p in _made[first:] if p not in kept]:
            discard(spark, path)


def last_path() -> str:
    """Where the last table was written."""
    return _made[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[:] = [p for p in _made if p != path]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table. One that is a single file is dealt over the cores, as a file of one row group is read by one task."""
    path = f"{sf_dir}/{name}.parquet"
    return tables.spread(spark.read.parquet(path), path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; Spark's lower() does just that to texts that are all ASCII, and is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a whole text, in order; null has none."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(LOWERED_WORD), F.lit(0))


def bag(found: Column, start: Column, n: int) -> Column:
    """A 64-bit hash of n words from position start (0-based), without copying them."""
    return F.xxhash64(*(F.get(found, start + k) for k in range(n)))


def same_array(a: Column, b: Column) -> Column:
    """Whether two arrays of a join are equal, looked at only for rows that agree in the join's keys.

    Written as an equality it would be a key itself, built for every row; as a lambda it would break generated code in two, and
    all rows that one text explodes to would wait between the halves, each with the whole text.
    """
    return (a >= b) & (a <= b)
