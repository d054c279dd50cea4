"""Quality classifier: expectation-maximisation weighs heuristic labellers, their posterior trains a hashed linear scorer.

1. Nine labellers vote good, bad or nothing on every document, from counts over its whole text.
2. Votes are grouped to patterns, 3 ** 9 at most whatever the corpus, and counted over all documents. Expectation-maximisation over
   these counts gives each labeller's rates among good and bad documents, and each pattern's posterior.
3. A logistic scorer over hashed byte trigrams (and repeated words) is fitted to the posteriors of a sample of ``sample`` documents
   at most, those with the smallest hashes of their ids, in one task: the driver gets the weights only. This is the only sample;
   everything else covers all documents.
4. All documents are scored by the fitted weights.

Each pass is numpy over the bytes of chunks of texts; where rows become rows of a matrix, a chunk has ``ROWS`` of them at most. No gold labels are used: the tests hold the result against them.

Edge cases: null, empty and wordless texts have nothing to vote on and are rejected with score 0; equal texts get equal scores; an
empty table gives an empty result; if all votes agree, the posterior is that of the votes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

BUCKETS, SAMPLE, ROUNDS, STEPS, THRESHOLD, CHUNK, ROWS = 2048, 4000, 60, 300, 0.5, 1 << 18, 256
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|<>{}[]\\^~=_@", dtype=np.uint8))
LABELLERS = ("symbols", "capitals", "exclamations", "bars", "repeats", "variety", "word_length", "sentences", "glued")
ABSTAIN, BAD, GOOD = 0, 1, 2


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def votes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, labellers) of votes, and the number of words of each row."""
    n = len(bounds) - 1
    h, row, start, length = wordhash.words(data, bounds)
    count = np.bincount(row, minlength=n).astype(np.float64)
    words = np.maximum(count, 1)
    upper, lower = (data >= 0x41) & (data <= 0x5A), (data >= 0x61) & (data <= 0x7A)
    full = np.maximum(_sums(data > 0x20, bounds), 1)
    capitals = _sums(upper, bounds) / np.maximum(_sums(upper | lower, bounds), 1)
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[1:][again], minlength=n) / words
    variety = np.bincount(wordhash.distinct(h, row)[1], minlength=n) / words
    mean = np.bincount(row, weights=length, minlength=n) / words
    follows = np.zeros(len(start), dtype=bool)
    end = start + length
    inner = end < len(data)
    follows[inner] = np.isin(data[end[inner]], np.frombuffer(b".,;:?", dtype=np.uint8)) & (end[inner] < bounds[row[inner] + 1])
    stops = np.bincount(row[follows], minlength=n) / words
    glued = np.bincount(row[inner][SYMBOLS[data[end[inner]]] & (end[inner] < bounds[row[inner] + 1])], minlength=n) / words

    def vote(x, good, bad, least=1):
        """good: at most or at least; bad: beyond. Both are (low, high) ranges."""
        out = np.full(n, ABSTAIN, dtype=np.int8)
        out[(x >= good[0]) & (x <= good[1])] = GOOD
        out[(x >= bad[0]) & (x <= bad[1])] = BAD
        out[count < least] = ABSTAIN
        return out

    top = np.inf
    out = np.stack(
        [
            vote(_sums(SYMBOLS[data], bounds) / full, (0, 0.01), (0.03, top)),
            vote(capitals, (0, 0.12), (0.3, top), 3),
            vote(_sums(data == 0x21, bounds) / words, (0, 0.03), (0.15, top), 3),
            vote(_sums(data == 0x7C, bounds) / words, (0, 0.02), (0.15, top), 3),
            vote(repeats, (0, 0.03), (0.15, top), 5),
            vote(variety, (0.4, 1), (0, 0.15), 20),
            vote(mean, (2.5, 12), (20, top), 5),
            vote(stops, (0.03, 0.5), (0, 0.005), 40),
            vote(glued, (0, 0.02), (0.1, top), 3),
        ],
        axis=1,
    )
    return out, count


def hashed(data: np.ndarray, bounds: np.ndarray, buckets: int) -> np.ndarray:
    """(rows, buckets): square roots of the shares of hashed byte trigrams and repeated words, so that rows have length 1."""
    n = len(bounds) - 1
    out = np.zeros(n * buckets, dtype=np.float64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    if len(data) > 2:
        x = data.astype(np.uint32)
        tri = ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
        inside = row[:-2] == row[2:]
        out += np.bincount(row[:-2][inside] * buckets + tri[inside] % np.uint32(buckets - 1), minlength=n * buckets)
    h, word_row, _, _ = wordhash.words(data, bounds)
    again = word_row[1:][(h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])]
    out += np.bincount(again * buckets + buckets - 1, minlength=n * buckets) * 4  # the last bucket is theirs; a word is worth some trigrams
    out = out.reshape(n, buckets)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def encode(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def decode(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each pattern of votes and how many documents have it; wordless ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for _, data, bounds in wordhash.chunks(batch.column(0)):
                v, count = votes(data, bounds)
                for code, k in zip(*np.unique(encode(v)[count > 0], return_counts=True), strict=True):
                    seen[int(code)] = seen.get(int(code), 0) + int(k)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    return docs.select(text_col).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def weigh(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation. Returns by code its posterior of good, each labeller's rate of bad votes among bad and good documents, and the share of good.

    A labeller's silence says nothing. Rates have priors, as counts that grow with the votes: the labellers are built to find
    one fault each and to spare good documents, so they miss most bad ones (0.3) and seldom hit a good one (0.01). The votes
    overrule the weak prior of the first kind soon, and the strong one of the second kind where a labeller errs often.
    """
    codes = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[c] for c in codes.tolist()], dtype=np.float64)
    v = decode(codes)
    voted, bad = v != ABSTAIN, v == BAD
    good = np.where(bad.any(axis=1), 0.1, 0.9)
    held = (n @ voted)[:, None] * [0.01, 0.2] + 1
    mean, prior, rates = np.array([0.3, 0.01]), 0.5, np.zeros((len(LABELLERS), 2))
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good], axis=1)
        rates = (bad.T @ weight + held * mean) / (voted.T @ weight + held)
        prior = min(max((n * good).sum() / max(n.sum(), 1), 1e-3), 1 - 1e-3)
        logs = np.log([1 - prior, prior]) + bad @ np.log(rates) + (voted & ~bad) @ np.log(1 - rates)
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    posterior = np.zeros(3 ** len(LABELLERS))
    posterior[codes] = good
    return posterior, rates, float(prior)


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps; the last weight is the intercept."""
    w, bias, last, was = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = 40.0
    for step in range(steps):
        beta = step / (step + 3)
        u, c = w + beta * (w - last), bias + beta * (bias - was)
        miss = 1 / (1 + np.exp(-np.clip(x @ u.astype(x.dtype) + c, -50, 50))) - y
        last, was = w, bias
        w, bias = u - rate / 10 * (x.T @ miss.astype(x.dtype) / len(y) + 1e-5 * u), c - rate / 10 * miss.mean()
    return w, float(bias)


def classify(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, score (probability of good) and keep."""
    counts = {r.pattern: r.n for r in patterns(docs, text_col).collect()}  # 3 ** 9 rows at most
    posterior, _, _ = weigh(counts)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def fitted(batches):
        x, y, n = np.empty((sample, buckets), dtype=np.float32), np.empty(sample), 0
        for batch in batches:
            for _, data, bounds in wordhash.chunks(batch.column(0), CHUNK, ROWS):
                v, count = votes(data, bounds)
                keep = np.flatnonzero(count > 0)
                x[n : n + len(keep)], y[n : n + len(keep)] = hashed(data, bounds, buckets)[keep], posterior[encode(v)[keep]]
                n += len(keep)
        if n:
            w, bias = fit_linear(x[:n], y[:n])
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    share = min(1.0, 0.8 * sample / max(1, sum(counts.values())))
    drawn = F.xxhash64(F.lit("sample"), "id", F.length("text"))
    some = slim.withColumn("draw", drawn).where(F.pmod("draw", F.lit(1_000_000)) < share * 1_000_000).orderBy("draw", "id").limit(sample).select("text")
    # The sample is one partition anyway, and its matrix never leaves the task: the driver gets the weights, one row or none.
    got = some.coalesce(1).mapInArrow(fitted, "w binary, bias double").collect()
    w32 = np.frombuffer(got[0].w).astype(np.float32) if got else np.zeros(buckets, dtype=np.float32)
    bias = got[0].bias if got else 0.0

    def scores(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, data, bounds in wordhash.chunks(batch.column(1), CHUNK, ROWS):
                _, row, _, _ = wordhash.words(data, bounds)
                full = np.bincount(row, minlength=len(bounds) - 1) > 0
                out[first : first + len(full)] = np.where(full, 1 / (1 + np.exp(-(hashed(data, bounds, buckets) @ w32 + bias))), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(out, 6))], ["id", "score"])

    done = slim.mapInArrow(scores, f"id {kind}, score double")
    return done.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", broadcast_ids: int = 2_000_000, **how) -> DataFrame:
    """docs without the rejected ones. Rows that share an id stay if any of them is good."""
    found = classify(docs, id_col=id_col, **how)
    (own,) = common.unused(docs, "_bad")
    bad = found.groupBy(id_col).agg(F.max("keep").alias("keep")).where("NOT keep").select(F.col(id_col).alias(own))
    bad = common.stored(bad.hint("rebalance"), "rejected")
    return docs.join(common.small_side(bad, broadcast_ids), F.col(id_col).eqNullSafe(F.col(own)), "left_anti")


def op10(spark, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"))
