"""One form for text that looks the same but is written in different characters.

Look-alike pairs (widths, canonical compositions, kinds of blank and hyphen, characters without ink,
look-alike letters of other scripts) are joined by union-find over strings and code points into
transitive classes. Each class is represented by the member that is most frequent in the data, and a
multi-pattern automaton rewrites the text greedily, longest match first, until nothing changes.

Texts are compared by what is read of them: there a run of blanks and line breaks is one blank, while the unified
text keeps its lines.

Defined results: null stays null, the empty text stays empty; a text of invisible characters alone becomes
empty; ties in frequency go to the shortest, then smallest member; repeated rows are kept.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.session import checkpointed, out_schema, widened

# Letters of other scripts and the Latin letter that they look like.
LETTERS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    "α": "a", "ϲ": "c", "ϳ": "j", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "γ": "y", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "к": "k", "т": "t", "м": "m", "н": "h", "в": "b", "г": "r", "п": "n", "ɑ": "a", "ɡ": "g", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Օ": "O", "Տ": "S", "Լ": "L",
}
# Hyphens; blanks that aren't of the Unicode class Zs; characters without ink that aren't of class Cf.
HYPHENS = "-‐‑﹣－⁃"
BLANKS = " \t"
INKLESS = "͏ᅟᅠㅤﾠ឴឵︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"


class Union:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        path = []
        while (y := self.up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return [sorted(m) for m in out.values()]


@functools.cache
def lookalike_classes() -> tuple[tuple[str, ...], ...]:
    """The transitive classes of all strings and code points known to look the same."""
    u = Union()
    for a, b in LETTERS.items():
        u.join(a, b)
    for h in HYPHENS[1:]:
        u.join(h, HYPHENS[0])
    for b in BLANKS:
        u.join(b, " ")
    for c in INKLESS:
        u.join(c, "")
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        category = unicodedata.category(c)
        if category == "Zs":
            u.join(c, " ")
        elif category == "Cf" and not 0x600 <= code <= 0x6FF:
            u.join(c, "")
        elif kind := unicodedata.decomposition(c):
            if kind.startswith(("<wide>", "<narrow>", "<small>")) or (kind.startswith("<compat>") and 0xFB00 <= code <= 0xFB06):
                u.join(c, unicodedata.normalize("NFKC", c))
            elif not kind.startswith("<"):
                plain = unicodedata.normalize("NFD", c)
                u.join(c, plain)
                if unicodedata.normalize("NFC", c) != c:
                    u.join(c, unicodedata.normalize("NFC", c))
    for a, b in ((" ", "\n"), ("\r\n", "\n"), ("\r", "\n"), ("\x85", "\n")):
        u.join(a, b)
    return tuple(tuple(m) for m in u.classes() if len(m) > 1)


class Rewriter:
    """Greedy rewriting of class members to representatives; ``counts`` are the frequencies of members."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.to: dict[str, str] = {}

        def often(m: str) -> int:
            return counts.get(m, 0) if len(m) == 1 else min(counts.get(c, 0) for c in m)

        for members in lookalike_classes():
            if "" in members:
                best = ""
            else:
                # a letter with its accent composed wins over its spelling in parts, whatever the counts
                whole = [m for m in members if len(m) == 1 and any(len(x) > 1 and unicodedata.normalize("NFC", x) == m for x in members)]
                best = min(whole or members, key=lambda m: (-often(m), unicodedata.normalize("NFKC", m) != m, len(m), m))
            for m in members:
                if m != best:
                    self.to[m] = best
        self.automaton = ahocorasick.Automaton()
        for m, best in self.to.items():
            self.automaton.add_word(m, (len(m), best))
        self.automaton.make_automaton()
        self.marks = frozenset(c for m in self.to for c in m if ord(c) > 127 or len(m) == 1)

    def once(self, text: str) -> str:
        out, at = [], 0
        for end, (n, best) in self.automaton.iter_long(text):
            start = end - n + 1
            out.append(text[at:start])
            out.append(best)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if not text.isascii() or "\t" in text or "\r" in text:
            seen = {text}
            while not self.marks.isdisjoint(text):  # an accent may meet its letter only when what stood between is gone
                text = self.once(text)
                if text in seen:
                    break
                seen.add(text)
        text = re.sub(" {2,}", " ", text)
        return re.sub(r" ?\n ?", "\n", text).strip(" ")


@functools.cache
def _members() -> frozenset[str]:
    return frozenset(m for members in lookalike_classes() for m in members if len(m) == 1)


def member_counts(df: DataFrame, column: str) -> dict[str, int]:
    """How often each look-alike code point stands in the column: at most one entry per code point of the classes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            total.update("".join(b[column].dropna()))
        keep = _members()
        got = [(c, n) for c, n in total.items() if c in keep]
        if got:
            yield pd.DataFrame(got, columns=["c", "n"])

    parts = widened(df.select(column)).mapInPandas(count, "c string, n long")
    return {r.c: r.n for r in parts.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def unify_text(df: DataFrame, column: str, out: str = "unified", counts: dict[str, int] | None = None) -> DataFrame:
    """Add ``out``: the column with every look-alike replaced by its class's most frequent member."""
    counts = member_counts(df, column) if counts is None else counts
    schema = out_schema(df, **{out: "string"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = Rewriter(counts)
        for b in batches:
            b[out] = [None if t is None else rewrite(t) for t in b[column]]
            yield b

    return widened(df).mapInPandas(run, schema)


def reading_key(unified: Column) -> Column:
    """What the eye reads of a unified text: every run of white space, line breaks among it, is one blank."""
    return F.trim(F.regexp_replace(unified, r"[\s\p{Z}]+", " "))


def _readings(df: DataFrame, key: str, column: str) -> DataFrame:
    """k, u (digest of what is read), w (digest of what is written) of every row with a text."""
    u = unify_text(df.select(key, column).filter(F.col(column).isNotNull()), column)
    return checkpointed(u.select(F.col(key).alias("k"), F.sha2(reading_key(F.col("unified")), 256).alias("u"), F.sha2(F.col(column), 256).alias("w")))


def visual_classes(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, class_no, writing_no, n_writings: one row for each row with a text.

    ``class_no`` is the smallest key of the rows that read the same, ``writing_no`` the smallest of those with the very
    string, ``n_writings`` the number of different strings of the class. Rows are grouped by aggregates alone, so a text
    that is captured by a third of all rows costs no more than its rows.
    """
    rows = _readings(df, key, column)
    writings = rows.groupBy("u", "w").agg(F.min("k").alias("writing_no"))
    classes = writings.groupBy("u").agg(F.min("writing_no").alias("class_no"), F.count("*").alias("n_writings"))
    return rows.join(writings.join(classes, "u"), ["u", "w"]).select(F.col("k").alias(key), "class_no", "writing_no", "n_writings")


def writing_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """class_no, writing_no: every other string of a class that reads like the class's first one, each by its smallest key."""
    return visual_classes(df, key, column).filter("writing_no <> class_no").select("class_no", "writing_no").distinct()


def visual_twins(df: DataFrame, key: str, column: str) -> DataFrame:
    """row_a, row_b (``row_a < row_b``): all rows whose text reads the same but is another string.

    Copies of one string are grouped before anything is paired, so a group of exact copies alone pairs nothing. The
    result grows with the square of a class; ``visual_classes`` says the same in one row a text.
    """
    rows = _readings(df, key, column)
    texts = rows.groupBy("u", "w").agg(F.count("*").alias("n"))
    several = texts.groupBy("u").agg(F.count("*").alias("writings")).filter("writings > 1").select("u")
    rows = rows.join(several, "u", "left_semi")
    a = rows.select(F.col("k").alias("row_a"), "u", F.col("w").alias("w_a"))
    b = rows.select(F.col("k").alias("row_b"), "u", F.col("w").alias("w_b"))
    return a.join(b, "u").filter("row_a < row_b and w_a <> w_b").select("row_a", "row_b")
