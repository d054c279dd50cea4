"""Source trees, transcripts, agent definitions, prices and policies, read as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from ..operators import governance
from ..schemas import PRICES, TIERS


def walk(spark: SparkSession, root: str, extensions=L.SOURCE_EXTENSIONS, excluded=L.EXCLUDED_DIRS, max_files: int | None = 5000) -> DataFrame:
    """The files of a tree that are worth reading: path (from root) and content. Names are filtered before contents are read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    parts = F.split(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _quoted(base.removeprefix("file://")) + "/*", ""), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    named = F.lit(False)
    for x in extensions:
        named = named | F.endswith(F.lower("path"), F.lit(x))
    kept = files.where((F.col("length") <= L.MAX_FILE_BYTES) & named & ~F.exists(dirs, lambda d: d.isin(*excluded) | F.startswith(d, F.lit("."))))
    kept = kept.select(F.array_join(parts, "/").alias("path"), "content")
    return kept if max_files is None else kept.orderBy("path").limit(max_files)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def texts(files: DataFrame) -> DataFrame:
    """content as text, wrong bytes replaced; files with a NUL near their start are left out."""
    t = files.select("path", _utf8(F.col("content")).alias("text"))
    return t.where(~F.contains(F.substring("text", 1, 4096), F.lit("\x00")))


def _utf8(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def transcripts(spark: SparkSession, glob: str) -> DataFrame:
    """Usage rows from JSON-lines transcripts, one folder per project: the first of each message counts; lines that aren't JSON are skipped."""
    usage = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
    schema = f"struct<type:string,timestamp:string,sessionId:string,message:struct<id:string,model:string,usage:{usage}>>"
    lines = spark.read.text(glob).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    u = lines.where((F.col("r.type") == "assistant") & F.col("r.message.usage").isNotNull() & (F.coalesce("r.message.id", F.lit("")) != ""))
    order = Window.partitionBy("message_id").orderBy("file", "at")
    u = u.select("file", "at", F.col("r.message.id").alias("message_id"), F.to_timestamp("r.timestamp").alias("ts"), F.coalesce("r.sessionId", F.lit("")).alias("session_id"), T.last_segment(F.element_at(F.split("file", "/"), -2)).alias("project"), F.coalesce("r.message.model", F.lit("")).alias("model"), *(F.coalesce(f"r.message.usage.{a}", F.lit(0)).alias(b) for a, b in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_input_tokens", "cache_read_tokens"), ("cache_creation_input_tokens", "cache_write_tokens"))))
    u = u.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "file", "at")
    return u.withColumn("cost_usd", governance.cost_usd(F.col("model"), *(F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"))))


def new_messages(found: DataFrame, usage: DataFrame) -> DataFrame:
    """Of found, what usage doesn't hold yet."""
    return found.join(usage.select("message_id"), "message_id", "left_anti")


def agents(files: DataFrame) -> DataFrame:
    """files: path (from the root), text. Agent definitions: name, project, model. Markdown names its model; Python only looks like an agent."""
    parts = F.split("path", "/")
    skip = F.exists(parts, lambda p: p.isin("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", "worktrees"))
    f = files.where((F.element_at(parts, -2) == "agents") & ~skip)
    md = F.endswith("path", F.lit(".md"))
    py = F.endswith("path", F.lit(".py")) & F.col("text").rlike(r"(?i)class\s+\w*Agent|Agent\(|agent") & ~F.endswith("path", F.lit("/__init__.py"))
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    model = F.when(md, F.regexp_extract(F.substring("text", 1, 2000), r"model:\s*([\w.\-]+)", 1)).otherwise("")
    return f.where(md | py).select(name.alias("name"), F.get(parts, F.lit(0)).alias("project"), model.alias("model"))


def prices(path: str | None = None) -> tuple:
    """(prefix, input, output) rows, from a JSON file {"models": {prefix: {"input", "output"}}} or the fixed ones."""
    if path is None:
        return PRICES
    with open(path, encoding="utf-8") as f:
        return tuple((k, float(v["input"]), float(v["output"])) for k, v in json.load(f)["models"].items())


def policies(raw: dict | None = None) -> list[tuple[str, int, int, int]]:
    """(tier, input cap, output cap, attempts) rows from a parsed policy {"tiers": [...], "controls": {...}}, checked; by default the fixed ones."""
    if raw is None:
        return [(t[0], *t[-3:]) for t in TIERS]
    tiers = raw.get("tiers")
    if not isinstance(tiers, list) or not tiers:
        raise ValueError("a policy must define one tier at least")
    attempts, out = int((raw.get("controls") or {}).get("max_recompression_attempts", 2)), {}
    for t in tiers:
        if not isinstance(t, dict) or not str(t.get("id", "")).strip():
            raise ValueError("a tier must be a mapping with an id")
        name, caps = str(t["id"]).strip(), [int(t.get(k, -1)) for k in ("input_token_cap", "output_token_cap")]
        if name in out or min(caps) < 0:
            raise ValueError(f"tier {name} is defined twice" if name in out else f"tier {name} has invalid caps")
        out[name] = (name, *caps, int(t.get("max_recompression_attempts", attempts)))
    return list(out.values())


def requests(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """JSON requests as call envelopes; what isn't an object gives nulls."""
    from ..schemas import ENVELOPE

    kind = "struct<" + ",".join(f"{x.split()[0]}:{x.split()[1].replace('long', 'bigint')}" for x in ENVELOPE.split(", ")) + ">"
    return payloads.select(F.from_json(col, kind).alias("e")).select("e.*")
