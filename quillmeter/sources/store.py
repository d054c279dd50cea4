"""The workspace store: cached chunks by path and fingerprint, and the ledger of offers, as Parquet tables under one folder.

Chunks are partitioned by a hash of their path, so that replacing a path rewrites its bucket only. The cache may always be
rebuilt; the ledger is appended to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import tokens
from ..operators import chunking, structure
from ..schemas import CHUNK, OFFER

BUCKETS = 64
FILES = "path string, fingerprint string, language string, chunk_count long, bucket int"


class Store:
    """A folder with the tables files, chunks and events. Nothing is held in memory."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        return self._read("files", FILES)

    def chunks(self) -> DataFrame:
        return self._read("chunks", f"{CHUNK}, bucket int").drop("bucket").orderBy("path", "start", "end")

    def events(self) -> DataFrame:
        return self._read("events", OFFER)

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _replace(self, name: str, schema: str, new: DataFrame, gone: DataFrame) -> None:
        """Rewrites the buckets of gone paths: what stays of them, and new."""
        touched = [r.b for r in gone.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets
        if not touched:
            return
        stay = self._read(name, schema).where(F.col("bucket").isin(touched)).join(gone.select("path"), "path", "left_anti")
        out = stay.unionByName(new.withColumn("bucket", self._bucket()))
        staged = f"{self.root}/.{name}"
        out.write.mode("overwrite").parquet(staged)  # a table can't be overwritten by what reads it
        self.spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")
        for b in set(touched) - {r.bucket for r in self.spark.read.parquet(staged).select("bucket").distinct().collect()}:
            self._delete(f"{self.root}/{name}/bucket={b}")

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def put(self, files: DataFrame, chunks: DataFrame) -> None:
        """Replaces all of the files' rows and chunks."""
        files = files.select("path", "fingerprint", "language", "chunk_count").cache()
        self._replace("chunks", f"{CHUNK}, bucket int", chunks, files)
        self._replace("files", FILES, files, files)
        files.unpersist()

    def sync(self, sources: DataFrame, most: int = chunking.MAX_TOKENS) -> int:
        """Chunks what has changed, forgets what is gone, and says how many files were parsed."""
        changed = structure.with_language(chunking.stale(sources, self.files())).cache()
        n = changed.count()
        if n:
            chunks = structure.structure_chunks(changed, most).cache()
            counts = chunks.groupBy("path").agg(F.count("*").alias("c"))
            files = changed.join(counts, "path", "left").select("path", "fingerprint", "language", F.coalesce("c", F.lit(0)).alias("chunk_count"))
            self.put(files, chunks)
            chunks.unpersist()
        changed.unpersist()
        self.forget_missing(sources)
        return n

    def cached(self, sources: DataFrame) -> DataFrame:
        """The stored chunks of sources whose content is as it was."""
        return self.chunks().join(chunking.fresh(sources, self.files()).select("path"), "path", "left_semi")

    def forget_missing(self, sources: DataFrame) -> None:
        gone = chunking.missing(self.files(), sources).cache()
        self._replace("chunks", f"{CHUNK}, bucket int", self.spark.createDataFrame([], CHUNK), gone)
        self._replace("files", FILES, self.spark.createDataFrame([], "path string, fingerprint string, language string, chunk_count long"), gone)
        gone.unpersist()

    def record(self, events: DataFrame) -> None:
        from ..operators.offers import recorded

        columns = [x.split() for x in OFFER.split(", ")]
        have = recorded(events)
        have.select(*((F.col(c) if c in have.columns else F.lit(0 if c == "claimed" else None)).cast(k).alias(c) for c, k in columns)).write.mode("append").parquet(f"{self.root}/events")

    def purge(self, cache_only: bool = False) -> None:
        for name in ("files", "chunks") if cache_only else ("files", "chunks", "events"):
            self._delete(f"{self.root}/{name}")


def fingerprints(sources: DataFrame) -> DataFrame:
    return sources.select("path", tokens.fingerprint(F.col("text")).alias("fingerprint"))
