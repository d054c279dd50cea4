"""The command line: each command builds small DataFrames and prints what the operators make of them. Exit codes: 0, 1 (nothing found), 2 (usage)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tokens as K
from .operators import headroom, offers, packing, retrieval, structure
from .schemas import PRESSURE
from .sources import files
from .sources.store import Store

OK, EMPTY, USAGE = 0, 1, 2


def session() -> SparkSession:
    return SparkSession.builder.appName("quillmeter").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _source(spark: SparkSession, args) -> DataFrame:
    path = getattr(args, "path", None) or "-"
    if path == "-":
        text = sys.stdin.read()
    else:
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
    s = spark.createDataFrame([(path, text)], "path string, text string")
    return s.withColumn("language", F.lit(args.language)) if getattr(args, "language", None) else s


def _show(rows: list, as_json: bool, line=str) -> int:
    dicts = [r.asDict(recursive=True) for r in rows]
    print(json.dumps(dicts, default=str) if as_json else "\n".join(line(r) for r in rows))
    return OK if rows else EMPTY


def _tree(spark, root: str) -> DataFrame:
    return files.texts(files.walk(spark, root))


def _chunks(spark, args) -> DataFrame:
    sources = _tree(spark, args.root)
    if args.no_cache:
        return structure.structure_chunks(sources, args.max_tokens)
    store = Store(spark, f"{args.root}/.quillmeter")
    store.sync(sources, args.max_tokens)
    return store.chunks()


def _hits(spark, args, k: int) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, args)
    query = spark.createDataFrame([(1, args.query)], "query_id int, text string")
    return retrieval.lexical_search(query, chunks, k), chunks


def count(spark, args):
    m = K.measured(_source(spark, args), "text", args.profile)
    m = m.withColumn("cost_usd", F.bround(K.cost_usd(F.col("tokens"), args.input_price, args.output_price), 6))
    return _show(m.drop("text").collect(), args.json, lambda r: f"{r.tokens} tokens ({r.profile}, {r.chars} chars, {r.lines} lines)")


def trim(spark, args):
    t = _source(spark, args).select(K.trim_to_budget(F.col("text"), args.budget, args.keep, args.hint).alias("r")).select("r.*")
    return _show(t.collect(), args.json, lambda r: r.text)


def room(spark, args):
    spends = [(x.rpartition("=")[0], int(x.rpartition("=")[2])) for x in args.spend or []] or [("session", 0)]
    s = spark.createDataFrame([("s", *x) for x in spends], "session_id string, lane string, tokens long")
    h = headroom.session_headroom(s, args.window, args.reserve_output, args.reserve_system, args.safety_margin)
    lanes = []
    for x in args.lane or []:
        name, weight, *rest = x.split(":")
        lanes.append((name, float(weight), int(rest[0]) if rest else 0, int(rest[1]) if len(rest) > 1 else None, 0))
    h = h.withColumn("gauge", headroom.gauge(F.col("ratio")))
    h = h.withColumn("plan", headroom.plan_lanes(F.col("available"), lanes)) if lanes else h
    return _show(h.collect(), args.json, lambda r: f"{r.gauge} {r.ratio * 100:5.1f}%  {r.pressure.upper()}\n  effective {r.effective}  used {r.used}  free {r.available}")


def skeleton(spark, args):
    s = _source(spark, args)
    k = structure.skeletons(s, structure.extract_symbols(s), not args.no_docs).where("symbols > 0")
    return _show(k.collect(), args.json, lambda r: r.skeleton)


def symbol(spark, args):
    s = _source(spark, args)
    chosen = s.select("path", F.lit(args.name).alias("selector"))
    return _show(structure.slice_symbol(s, structure.extract_symbols(s), chosen).collect(), args.json, lambda r: r.text)


def outline(spark, args):
    o = structure.outlines(structure.extract_symbols(_source(spark, args))).orderBy("seq")
    return _show(o.collect(), args.json, lambda r: ("  " if r.under else "") + f"{r.kind} {r.name} {r.start}-{r.end}")


def chunk(spark, args):
    c = structure.structure_chunks(_source(spark, args), args.max_tokens).orderBy("start")
    return _show(c.collect(), args.json, lambda r: f"{r.id}  {r.tokens}t  {r.kind}")


def search(spark, args):
    hits, chunks = _hits(spark, args, args.k)
    h = hits.join(chunks, "id").orderBy("rank").select("rank", "id", "path", "start", "end", "symbol", "tokens", (F.col("score") / retrieval.UNIT).alias("score"))
    return _show(h.collect(), args.json, lambda r: f"{r.rank:>3}  {r.score:.3f}  {r.id}")


def pack(spark, args):
    share = args.used / max(1, int((args.window - args.reserve_output) * 0.98))
    band = next((p for p in PRESSURE if share < p[1]), PRESSURE[-1])
    if args.files:
        rows = []
        for path in args.files:
            with open(path, encoding="utf-8", errors="replace") as f:
                rows.append((path, f.read()))
        s = spark.createDataFrame(rows, "path string, text string")
        k = structure.skeletons(s, structure.extract_symbols(s)).select("path", "skeleton", K.estimate_tokens(F.col("skeleton")).alias("skeleton_tokens"))
        f = s.join(k, "path").withColumn("request_id", F.lit(1)).withColumn("tokens", K.estimate_tokens(F.col("text")))
        return _show(packing.pack_files(f, args.budget).collect(), args.json, lambda r: r.text)
    if not args.query:
        return USAGE
    hits, chunks = _hits(spark, args, 3 * (band[4] if args.used else 8) * retrieval.OVERFETCH)
    p = packing.manifest(packing.pack_query(hits, chunks, args.budget, band[0], args.section_cap))
    return _show(p.collect(), args.json, lambda r: r.manifest if args.manifest else r.text)


def hook(spark, args):
    r = offers.routed(spark.createDataFrame([(sys.stdin.read(),)], "payload string"), args.root)
    return _show(r.collect(), True)


def stats(spark, args):
    events = Store(spark, f"{args.root}/.quillmeter").events()
    return _show(offers.best_savings(events, args.limit).collect(), args.json, lambda r: f"{r.path}  {r.tokens_saved}t saved, {r.accepted} of {r.offers}")


def forget(spark, args):
    Store(spark, f"{args.root}/.quillmeter").purge(args.cache_only)
    return OK


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmeter")
    top.add_argument("--version", action="version", version="quillmeter 0.1")
    sub = top.add_subparsers(dest="command", required=True)

    def add(f, name, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        p.add_argument("--json", action="store_true")
        for names, how in options:
            p.add_argument(*names.split(), **how)

    path, flag, whole = ("path", {"nargs": "?"}), {"action": "store_true"}, {"type": int}
    number = lambda v: {"type": type(v), "default": v}
    root, language, most, cache = ("--root", {"default": "."}), ("--language", {}), ("--max-tokens", number(512)), ("--no-cache", flag)
    add(count, "count", path, ("--profile", {}), ("--input-price", number(0.0)), ("--output-price", number(0.0)))
    add(trim, "trim", path, ("--budget", {"type": int, "required": True}), ("--keep", {"choices": ["head", "tail", "both"], "default": "head"}), ("--hint", {"default": ""}))
    add(room, "headroom", ("--window", number(200_000)), ("--reserve-output", number(8000)), ("--reserve-system", number(0)), ("--safety-margin", number(0.02)), ("--spend", {"action": "append"}), ("--lane", {"action": "append"}))
    add(skeleton, "skeleton", path, language, ("--no-docs", flag))
    add(symbol, "symbol", ("path", {}), ("name", {}), language)
    add(outline, "outline", path, language)
    add(chunk, "chunk", path, language, most)
    add(search, "search", ("query", {}), root, ("-k", number(10)), most, cache)
    add(pack, "pack", ("query", {"nargs": "?", "default": ""}), root, ("--files", {"nargs": "*"}), ("--budget", number(6000)), ("--window", number(200_000)), ("--reserve-output", number(8000)), ("--used", number(0)), ("--section-cap", whole), most, ("--manifest", flag), cache)
    add(hook, "hook", root, cache)
    add(stats, "stats", root, ("--limit", number(15)))
    add(forget, "forget", root, ("--cache-only", flag))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(session(), args)


if __name__ == "__main__":
    sys.exit(main())
