"""Search terms and paths, as column functions."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no signal in source text.
STOPWORDS = (
    "a an the and or of to in for on at by is are be was were this that these those it its as with from if else return not no yes do does did can will would should "
    "self cls def class import export const let var function new"
).split()
WORD = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+"
PARTS = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"


def terms(text: Column, split_identifiers: bool = True) -> Column:
    """Lower-case terms in order, each identifier followed by its parts if it has several."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    keep = lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS)
    if not split_identifiers:
        return F.filter(F.transform(raw, F.lower), keep)

    def expand(word):
        parts = F.regexp_extract_all(F.replace(word, F.lit("_"), F.lit(" ")), F.lit(PARTS), F.lit(0))
        several = F.transform(F.array(parts), lambda p: F.when(F.size(p) > 1, F.concat(F.array(F.lower(word)), F.transform(p, F.lower))).otherwise(F.array(F.lower(word))))[0]
        return F.when(word.rlike("^.+[A-Z_0-9]"), several).otherwise(F.array(F.lower(word)))

    return F.filter(F.flatten(F.transform(raw, expand)), keep)


class TermCounter:
    """Counts the same terms of texts in Python. What a word gives is remembered, as most words come again, and so are a few lines, as windows of a text overlap."""

    def __init__(self, most: int = 50_000, lines: int = 1_000, terms_: int = 100_000):
        self.word, self.parts, self.several = re.compile(WORD.replace(r"\p{Nd}", r"\d")), re.compile(PARTS), re.compile(r".+[A-Z_0-9]")
        self.stop, self.known, self.most = frozenset(STOPWORDS), {}, most
        self.lines, self.held, self.most_lines, self.most_terms = {}, 0, lines, terms_

    def expand(self, word: str) -> tuple[str, ...]:
        out = [word.lower()]
        if self.several.match(word) and len(parts := self.parts.findall(word.replace("_", " "))) > 1:
            out += [p.lower() for p in parts]
        out = tuple(t for t in out if len(t) > 1 and t not in self.stop)
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = out
        return out

    def of_line(self, line: str) -> list[str]:
        get = self.known.get
        out = []
        for word in self.word.findall(line):
            found = get(word)
            out += self.expand(word) if found is None else found
        if len(self.lines) >= self.most_lines or self.held > self.most_terms:
            self.lines.clear()
            self.held = 0
        self.lines[line] = out
        self.held += len(out)
        return out

    def count(self, text: str) -> dict[str, int]:
        out: Counter[str] = Counter()
        for line in text.split("\n"):
            found = self.lines.get(line)
            out.update(self.of_line(line) if found is None else found)
        return out


def citation(path: Column, start: Column, end: Column, symbol: Column | None = None) -> Column:
    place = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return place if symbol is None else F.when(F.coalesce(symbol, F.lit("")) == "", place).otherwise(F.concat(place, F.lit(" ("), symbol, F.lit(")")))


def resolved(path: Column, root: str) -> Column:
    """path as an absolute one with "." and ".." resolved, or null if it leaves root. Links aren't followed: there may be no disk below."""
    base = root.rstrip("/")
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base + "/"), path))

    def step(acc, part):
        return F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    out = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/", -1), F.array().cast("array<string>"), step), "/"))
    return F.when((F.coalesce(path, F.lit("")) != "") & ((out == (base or "/")) | F.startswith(out, F.lit(base + "/"))), out)


def last_segment(name: Column) -> Column:
    """The last part of a name whose parts are joined by dashes, dashes at its end left out; the name itself if that is empty."""
    part = F.element_at(F.split(F.regexp_replace(name, "-+$", ""), "-", -1), -1)
    return F.when(part == "", name).otherwise(part)
