"""Texts in windows of whole lines under a token budget, each window citing its lines."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens

MAX_TOKENS, MIN_TOKENS, OVERLAP, CUT_CHARS = 512, 24, 4, 4_000_000


def line_cost(text: str) -> int:
    """Tokens of text as code, by characters."""
    if not text:
        return 0
    ends = text.count("\n")
    return max(1, math.ceil((len(text) - ends) / tokens.DIVISORS["code"]) + ends)


def line_windows(costs: list[int], most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open line ranges from 0, in one pass. A window always takes its first line, and begins overlap lines before the end of the last."""
    out, cur, end, used = [], 0, 0, 0
    while cur < len(costs):
        if end == cur:
            end, used = cur + 1, costs[cur]
        while end < len(costs) and used + costs[end] <= most:
            used, end = used + costs[end], end + 1
        out.append((cur, end))
        if end == len(costs):
            break
        new = max(end - overlap, cur + 1)
        used -= sum(costs[cur:new])
        cur = new
    return out


def window_chunks(sources: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP, language: str = "text") -> DataFrame:
    """sources: path, text. A row per window: id, path, start, end (lines from 1), tokens, language, kind, text. Blank texts have none.

    Lines are charged as code, as windows of sources are. Texts are cut in one Arrow pass, without a shuffle.
    """
    ansi = re.compile(tokens.ANSI)

    def cut(batches):
        for batch in batches:
            out, held = ([], [], [], []), 0
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = text.as_py().split("\n")
                costs = [line_cost(ansi.sub("", x) if "\x1b" in x else x) + 1 for x in lines]
                for i, j in line_windows(costs, most, overlap):
                    for column, value in zip(out, (path, i + 1, j, "\n".join(lines[i:j])), strict=True):
                        column.append(value)
                    held += len(out[3][-1])
                if held >= CUT_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["path", "start", "end", "text"])
                    out, held = ([], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["path", "start", "end", "text"])

    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
    s = sources.where(F.col("text").rlike(f"[^{tokens.SPACE}]")).select("path", "text").mapInArrow(cut, "path string, start int, end int, text string")
    place = F.concat(F.lit("#"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return s.select(F.concat("path", place).alias("id"), "path", "start", "end", tokens.estimate_tokens(F.col("text")).alias("tokens"), F.lit(language).alias("language"), F.lit(None).cast("string").alias("symbol"), F.lit("window").alias("kind"), F.lit("").alias("signature"), "text")


def cited(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("citation", T.citation(F.col("path"), F.col("start"), F.col("end"), F.col("symbol")))


def stale(sources: DataFrame, index: DataFrame) -> DataFrame:
    """sources (path, text) whose content isn't in index (path, fingerprint): they are to be chunked again."""
    return sources.withColumn("fingerprint", tokens.fingerprint(F.col("text"))).join(index.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def fresh(sources: DataFrame, index: DataFrame) -> DataFrame:
    return sources.withColumn("fingerprint", tokens.fingerprint(F.col("text"))).join(index.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi")


def missing(index: DataFrame, sources: DataFrame) -> DataFrame:
    """Paths in index that sources no longer has."""
    return index.select("path").distinct().join(sources.select("path"), "path", "left_anti")
