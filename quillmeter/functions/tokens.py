"""What text costs in tokens, as column functions (no Python runs per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters per token of each content profile.
DIVISORS = {"prose": 4.0, "markdown": 3.8, "mixed": 3.5, "code": 3.2, "json": 2.9, "base64": 1.4}
#: How a profile is told.
SAMPLE, BASE64_LEAST, BASE64_SPACE, JSON_DENSITY, CODE_DENSITY, MIXED_DENSITY = 8192, 128, 0.02, 0.08, 0.045, 0.02
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
CODE_CHARACTERS = r"{}();=<>\[\]|&$#@"
CODE_SIGNALS = rf"[{CODE_CHARACTERS}]|=>|::|->"
JSON_CHARACTERS = r'"{}\[\]:,'
JSON_SIGNALS = f"[{JSON_CHARACTERS}]"
MARKDOWN = r"^(#{1,6} |```)"
#: White space and line ends as Unicode text has them, spelled out because regex engines differ.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TRIM_RESERVE = 48


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use takes it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    """text without terminal escape sequences; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit("\x1b")), F.regexp_replace(text, ANSI, "")).otherwise(text)


def trimmed(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def count_of(text: Column, characters: str) -> Column:
    """How many of text's characters are in a class, by what is left without them: no array of matches is made."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def few_of(text: Column, characters: str) -> Column:
    """The same for characters that are rare: the text isn't written anew."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def code_signals(text: Column) -> Column:
    """How often CODE_SIGNALS matches: "=>" counts as two signs, "->" as its second one, "::" as one."""
    return few_of(text, CODE_CHARACTERS) + ((F.length(text) - F.length(F.replace(text, F.lit("::"), F.lit("")))) / 2).cast("int")


def profile_of(clean: Column) -> Column:
    """The content profile of a text without escape sequences. What tells most texts apart at once is asked first."""

    def told(sample):
        size = F.length(sample)
        dense = lambda body: bound(F.struct(F.length(body).alias("all"), count_of(body, SPACE).alias("spaces")), lambda n: (n["all"] - n["spaces"] > BASE64_LEAST) & (n["spaces"] / n["all"] < BASE64_SPACE))
        encoded = ~sample.rlike(f"[^A-Za-z0-9+/={SPACE}]") & bound(trimmed(sample), dense)
        json = sample.rlike(rf"\A[{SPACE}]*[\[{{]") & sample.rlike(rf"[\]}}][{SPACE}]*\z") & (few_of(sample, JSON_CHARACTERS) / size > JSON_DENSITY)
        density = code_signals(sample) / size
        plain = bound(density, lambda d: F.when(d > CODE_DENSITY, "code").when(sample.rlike(f"(?md){MARKDOWN}"), "markdown").when(d > MIXED_DENSITY, "mixed").otherwise("prose"))
        return F.when(~sample.rlike(f"[^{SPACE}]"), "prose").when(encoded, "base64").when(json, "json").otherwise(plain)

    return bound(F.substring(clean, 1, SAMPLE), told)


def detect_profile(text: Column) -> Column:
    return profile_of(stripped(text))


def divisor(profile: Column) -> Column:
    """Characters per token; an unknown profile counts as mixed."""
    table = F.create_map(*(F.lit(x) for pair in DIVISORS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, profile), F.lit(DIVISORS["mixed"]))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def tokens_of(clean: Column, by: Column) -> Column:
    """Tokens of a text without escape sequences at by characters each; a newline is one more."""
    cost = bound(newlines(clean), lambda ends: F.greatest(F.lit(1), F.ceil((F.length(clean) - ends) / by) + ends))
    return F.when(clean == "", F.lit(0)).otherwise(cost).cast("long")


def priced(clean: Column, profile: str | None = None) -> Column:
    """Tokens of a text without escape sequences."""
    auto = profile in (None, "auto")
    return tokens_of(clean, divisor(profile_of(clean)) if auto else F.lit(DIVISORS.get(profile, DIVISORS["mixed"])))


def estimate_tokens(text: Column, profile: str | None = None) -> Column:
    return bound(stripped(text), lambda clean: priced(clean, profile))


def count_lines(text: Column) -> Column:
    """Lines as text editors count them: any line end ends one, and an end at the very end begins none."""
    ends = F.regexp_count(text, F.lit(LINE_END))
    return (ends + F.when((text == "") | text.rlike(rf"(?:{LINE_END})\z"), 0).otherwise(1)).cast("long")


def measured(df: DataFrame, text_col: str, profile: str | None = None) -> DataFrame:
    """df with tokens, chars, lines, bytes, profile and chars_per_token of its text, each computed once."""
    out = df.withColumn("_clean", stripped(F.col(text_col)))
    out = out.withColumn("profile", profile_of(F.col("_clean")) if profile in (None, "auto") else F.lit(profile)).withColumn("chars_per_token", divisor(F.col("profile")))
    clean = F.col("_clean")
    return (
        out.withColumn("tokens", tokens_of(clean, F.col("chars_per_token")))
        .withColumn("chars", F.length(clean).cast("long"))
        .withColumn("lines", count_lines(clean))
        .withColumn("bytes", F.octet_length(clean).cast("long"))
        .drop("_clean")
    )


def cost_usd(tokens: Column, input_per_mtok: float = 0.0, output_per_mtok: float = 0.0, output_tokens: Column | int = 0) -> Column:
    """Unrounded; reports round to six places."""
    out = output_tokens if isinstance(output_tokens, Column) else F.lit(output_tokens)
    return (tokens / F.lit(1e6)) * input_per_mtok + (out / F.lit(1e6)) * output_per_mtok


def chars_by_four(*chars: Column) -> Column:
    total = chars[0]
    for c in chars[1:]:
        total = total + c
    return F.floor(total / 4).cast("long")


def taken(costs: Column, allowance: Column) -> Column:
    """How many leading elements fit: it stops at the first that doesn't."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc, cost):
        over = acc["full"] | (acc["used"] + cost > allowance)
        return F.struct(F.when(over, acc["used"]).otherwise(acc["used"] + cost).alias("used"), F.when(over, acc["n"]).otherwise(acc["n"] + 1).alias("n"), over.alias("full"))

    return F.aggregate(costs, start, step, lambda acc: acc["n"])


def trim_to_budget(text: Column, budget: Column | int, keep: str = "head", hint: str | Column = "", profile: str | None = None) -> Column:
    """A struct (text, truncated, kept_lines, total_lines, tokens): text cut to whole lines of its head, tail or both, with a note of what is gone.

    As lines are charged one by one, and the note has a reserve of its own, a budget below the note's cost isn't kept.
    """
    if keep not in ("head", "tail", "both"):
        raise ValueError("keep must be head, tail or both")
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    hint = hint if isinstance(hint, Column) else F.lit(hint)
    kind = "struct<text:string,truncated:boolean,kept_lines:int,total_lines:int,tokens:bigint>"

    def fitting(lines, allowance):
        """How many leading lines fit. As each costs one token or more, and no less than the largest divisor says, only those that then fit are priced."""
        least = lambda x: F.ceil(F.length(stripped(x)) / max(DIVISORS.values())) + 1
        some = lambda found: F.slice(found, 1, taken(F.transform(found, least), allowance))
        return taken(F.transform(bound(F.slice(lines, 1, allowance.cast("int")), some), lambda x: estimate_tokens(x, profile) + 1), allowance)

    def cut(clean, total, lines):
        n, body = F.size(lines), F.greatest(F.lit(1), budget - TRIM_RESERVE)
        none = F.array().cast("array<string>")
        if keep == "head":
            counts = fitting(lines, body)
            kept = lambda count: F.struct(count.alias("count"), F.slice(lines, 1, count).alias("lines"))
        elif keep == "tail":
            counts = fitting(F.reverse(lines), body)
            kept = lambda count: F.struct(count.alias("count"), F.when(count == 0, none).otherwise(F.slice(lines, n - count + 1, count)).alias("lines"))
        else:
            half = F.greatest(F.lit(1), F.floor(body / 2))
            ends = F.struct(fitting(lines, half).alias("head"), fitting(F.reverse(lines), body - half).alias("tail"))
            counts = bound(ends, lambda x: F.struct(F.least(x["head"], n - x["tail"]).alias("head"), x["tail"].alias("tail")))

            def kept(x):
                middle = F.array(F.concat(F.lit("... "), (n - x["tail"] - x["head"]).cast("string"), F.lit(" lines elided ...")))
                tail = F.when(x["tail"] == 0, none).otherwise(F.slice(lines, F.greatest(n - x["tail"], F.lit(0)) + 1, x["tail"]))
                return F.struct((x["head"] + x["tail"]).alias("count"), F.concat(F.slice(lines, 1, x["head"]), middle, tail).alias("lines"))

        return bound(bound(counts, kept), lambda x: noted(total, n, x["count"], x["lines"]))

    def noted(total, n, count, kept):
        note = F.concat(F.lit("[trimming] truncated to fit "), budget.cast("string"), F.lit(" tokens ("), total.cast("string"), F.lit(" estimated, "), n.cast("string"), F.lit(f" lines, keeping {keep})."), F.when(hint == "", "").otherwise(F.concat(F.lit(" "), hint)))
        joined = F.array_join(kept, "\n")
        whole = F.concat(note, F.lit("\n"), joined) if keep == "tail" else F.concat(joined, F.lit("\n"), note)
        return bound(whole, lambda t: F.struct(t.alias("text"), F.lit(True).alias("truncated"), count.cast("int").alias("kept_lines"), n.alias("total_lines"), estimate_tokens(t, profile).alias("tokens")).cast(kind))

    def made(x):
        same = F.struct(x["clean"].alias("text"), F.lit(False).alias("truncated"), F.size(x["lines"]).alias("kept_lines"), F.size(x["lines"]).alias("total_lines"), x["total"].alias("tokens")).cast(kind)
        return F.when(x["total"] <= budget, same).otherwise(cut(x["clean"], x["total"], x["lines"]))

    price = lambda clean: F.struct(clean.alias("clean"), priced(clean, profile).alias("total"), F.split(clean, "\n", -1).alias("lines"))
    return bound(bound(stripped(text), price), made)


def fingerprint(text: Column) -> Column:
    return F.concat_ws(":", F.length(text).cast("string"), F.substring(F.sha2(text, 256), 1, 32))
