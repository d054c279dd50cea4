"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only.

Texts are gathered into batches of about ``batch_bytes`` bytes, whatever batches Arrow brings them in, and cut at safe boundaries into units. A boundary is safe before a
run of spaces that follows something else: pieces of the vocabulary hold the space mark at their front only (checked when the
model is loaded), so no merge crosses there, and the counts of the units add up to the count of the text. Equal units are
encoded once a batch, and short ones are remembered by the worker in a table of bounded size. Without such a vocabulary whole
texts are encoded.

Edge cases: null is the empty text, of no tokens; equal rows are counted each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MODEL, LIMIT, BATCH_BYTES, MOST_ROWS, CACHE, CACHED_CHARS = "piece_bpe_32k.model", 4096, 4_000_000, 50_000, 400_000, 48
MARK = "▁"
RUNS = re.compile(" +[^ ]*")


class UnitCounter:
    """Counts the tokens of texts by a SentencePiece model."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        self.model, self.cache, self.most = sentencepiece.SentencePieceProcessor(model_file=path), {}, cache
        pieces = (self.model.id_to_piece(k) for k in range(self.model.get_piece_size()))
        self.safe = not any(MARK in p.lstrip(MARK) for p in pieces) and self._plain()

    def _plain(self) -> bool:
        """Whether the model prepends one mark, keeps all spaces and changes no character, as splitting needs."""
        return self.model.decode(self.model.encode("ﬁ  x ")) == "ﬁ  x "

    @staticmethod
    def units(text: str) -> list[str]:
        """Units, each without the one space that the model prepends; "" stands for a single space at the end."""
        text = text.replace(MARK, " ")
        if "  " not in text:
            return text.split(" ") if not text.startswith(" ") else [" " + (rest := text[1:].split(" "))[0], *rest[1:]]
        return [u[1:] for u in RUNS.findall(" " + text)]

    def _encode(self, units: list[str]) -> list[int]:
        return [len(x) if u else 1 for u, x in zip(units, self.model.encode(units, num_threads=1), strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        split = [self.units(t) if t else [] for t in texts]
        known = self.cache
        missing = set().union(*split).difference(known)
        if missing:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = set().union(*split)
            new = sorted(missing)
            fresh = dict(zip(new, self._encode(new), strict=True))
            known.update(fresh)
        out = [sum(map(known.__getitem__, u)) for u in split]
        for u in [u for u in missing if len(u) > CACHED_CHARS]:
            del known[u]
        if len(known) > self.most:
            known.clear()
        return out


def pieces_of(text: str, size: int) -> Iterator[str]:
    """A long text in parts of about size characters, cut where a single space stands between two other characters; that space is left out."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut >= 0 and (cut + 1 >= len(text) or text[cut - 1] in f" {MARK}" or text[cut + 1] in f" {MARK}"):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def token_lengths(batches: Iterator[pa.RecordBatch], path: str, batch_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    counter = UnitCounter(path)
    waiting, pending, owner, held, rows = [], [], [], 0, 0  # waiting: batches of which some texts aren't counted yet

    def flush():
        for (out, k), n in zip(owner, counter.count(pending), strict=True):
            out[k] += n
        pending.clear()
        owner.clear()

    def done():
        for batch, out in waiting:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int64())], ["id", "n_bytes", "n_tokens"])
        waiting.clear()

    for batch in batches:
        out = [0] * batch.num_rows
        for k, value in enumerate(batch.column(1)):
            text = value.as_py() or ""
            for part in pieces_of(text, batch_bytes // 4) if counter.safe else [text]:
                pending.append(part)
                owner.append((out, k))
                held += len(part) if part.isascii() else len(part.encode())
                if held >= batch_bytes:
                    flush()
                    yield from done()
                    held = rows = 0
        waiting.append((batch, out))
        rows += batch.num_rows
        if rows >= MOST_ROWS:
            flush()
            yield from done()
            held = rows = 0
    flush()
    yield from done()


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_bytes, n_tokens, over_limit. model: a path that every worker can open; by default the public 32k model."""

    def lengths(batches):
        path = model
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        yield from token_lengths(batches, path, batch_bytes)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = slim.schema["id"].dataType.simpleString()
    counted = slim.mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
