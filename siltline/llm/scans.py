"""Noise of scanning and page layout in extracted text, found and repaired.

Misread words: the words of all texts are counted; forms with the same confusable-glyph skeleton are grouped,
and a rare form gives way to the form of its group that is far more frequent and stands beside the same
neighbours elsewhere in the data. Headers: lines at page edges, with page numbers masked, that
come back in the item or in other items of the post, judged by how often lines of that make come back at all.
Hyphens at line ends: the joined and the hyphenated word are looked up in the counted words. The text is
then reflowed into paragraphs with SQL windows over its lines.

Misread forms are looked for in one scan whatever their number: the workers hold a bit table of their hashes, and what
hits it is joined to the forms afterwards. Every other step joins by key after partial aggregation, and the lines
of a title are spread over SALT keys, so a post with many items is no hot group. Tables that grow with the data and are read
from a checkpoint are joined by sorting (``sorted_side``), so the driver never holds one.

Defined results: null texts have no defects and stay null; empty texts, and texts of nothing but page numbers and titles,
come out empty; items of a null post are compared with nothing but themselves; rows that repeat another one have the same
defects and are no second place for a header.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltline.session import checkpointed, widened

MIN_GOOD, MIN_RATIO = 10, 10  # a form to restore stands so often, and so many times as often as the misread one
RECURRING = 0.5  # share of lines of a make that must come back for its lines to count as headers
LEAST_BITS, MOST_BITS = 20, 30  # the bit table has 2 ** so many bits: at least 64 for each form, or MOST_BITS
PROBES = 3  # bits of each form
SALT = 16  # keys over which the lines of one title are spread
PIECE = 18  # the bit table is put together in pieces of 2 ** so many bits
# Glyphs that scanning confuses, and what stands for them in a skeleton. Each glyph is replaced by itself,
# wide ones by the narrow ones that they are taken for, so no order of replacing matters: cl, c1, el and d are all 'el'.
NARROW = str.maketrans("c51i+0@9ſ6h", "eslltoagfbb")
WIDE = {"m": "rn", "d": "el", "w": "vv", "u": "ll"}
TAKEN = {"rn": "m", "cl": "d", "vv": "w", "ii": "u"}
_GLYPHS = NARROW | str.maketrans(WIDE)
_WORD = re.compile(r"[\w@+]+(?:[-‐][\w@+]+)*")
_PAGE = re.compile(r"^(?:(?:page|seite|página|pagina|p\.|pg\.?|slide|folie)\s*\d+(?:\s*(?:of|von|de|sur|di|van|/)\s*\d+)?|[—–-]\s*\d+\s*[—–-]|\[\s*\d+\s*\]|\d{1,5}\s*/\s*\d{1,5}|\d{1,5}|(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))$", re.I)
_PAGE_END = frozenset("0123456789]—–-ivxlcIVXLC")
_MARKS_OF_BREAKS = "¬\xad="
_LETTERS = re.compile(r"[^\W\d_]+")
_AFFIX = r"\d{1,4}|[ivxlc]{1,7}"
_LEAD = re.compile(rf"^({_AFFIX})\s{{2,}}(?=\S)")
_TRAIL = re.compile(r"((?:\s+\d{1,4})+)$")
_PROSE_END = frozenset(".,;-‐¬\xad=(")
_BREAK_END = frozenset("-‐¬\xad=")
_PROSE = re.compile(r"[.!?;]\s|[.,;\-‐¬\xad=(]$")


def is_page_number(line: str) -> bool:
    """Whether a line holds a page number and nothing else."""
    line = line.strip()
    return line[-1:] in _PAGE_END and bool(_PAGE.match(line))


def broken_word(line: str) -> tuple[str, str] | None:
    """(letters, mark) of a word that a mark splits at the end of its line."""
    line = line.rstrip()
    if line[-1:] not in _BREAK_END:
        return None
    at = len(line) - 1
    while at and line[at - 1].isalpha():
        at -= 1
    return (line[at:-1], line[-1]) if at < len(line) - 1 else None


@functools.lru_cache(maxsize=100_000)
def skeleton(word: str) -> str:
    """The word with its confusable glyphs unified."""
    return word.translate(_GLYPHS)


def confusable(a: str, b: str) -> bool:
    """Whether glyphs of one word are taken for those of the other; equal skeletons alone also make 'il' of 'u'."""
    todo, seen = [(0, 0)], set()
    while todo:
        i, j = todo.pop()
        if (i, j) in seen:
            continue
        seen.add((i, j))
        if i == len(a) and j == len(b):
            return True
        x, y = a[i : i + 2], b[j : j + 2]
        if x and y and x[0].translate(NARROW) == y[0].translate(NARROW):
            todo.append((i + 1, j + 1))
        if y and TAKEN.get(x) == y[0]:
            todo.append((i + 2, j + 1))
        if x and TAKEN.get(y) == x[0]:
            todo.append((i + 1, j + 2))
    return False


def title_parts(line: str, edge: bool = True) -> tuple[str, str, str] | None:
    """(key, page number, shape of the numbers) of a line that could be a running title; the key is free of page numbers and style.

    Off the edge of a page, lines that begin in lower case or end in a question, call or colon are prose.
    """
    t = line.strip("\x0c \t|~*_—–=#<>")
    # most lines are prose and leave here
    if not t or t[-1] in _PROSE_END or ". " in t or (not edge and (t[-1] in ":!?" or (t[0].islower() and t[0] not in "ivxlc"))):
        return None
    lead = ""
    if m := _LEAD.match(t):
        lead, t = m.group(1), t[m.end() :].strip("|~*_—–=#<> ")
    if not t or _PROSE.search(t) or (not edge and t[0].islower()):
        return None
    trail, wide = [], ""
    while m := _TRAIL.search(t):
        trail, gap = m.group(1).split() + trail, re.match(r"\s*", m.group(1)).group()
        t = t[: m.start()]
        wide = "w" if re.search(r"\S {2,}\S", t) else "n" if len(gap) > 1 else "-"
        t = t.strip("|~*_—–=#<> ")
    words = re.findall(r"\w+", t.lower())
    if len(words) < 2:
        return None
    key = " ".join(skeleton(w) for w in words)
    if lead:
        return key, lead, "lead"
    if len(trail) > 1:
        return key, trail[-1], "lead"
    return key, (trail[0] if trail else ""), {"n": "lead", "w": "wide"}.get(wide, "none")


def page_lines(lines: list[str], kind: str | None) -> tuple[list[int], set[int], set[int]]:
    """(lines with ink, lines at page edges, lines that are a page number) of a text."""
    filled = [k for k, x in enumerate(lines) if x.strip()]
    edge = {*filled[:2], *filled[-2:]}
    if any("\x0c" in x for x in lines):
        for n, k in enumerate(filled):
            if "\x0c" in lines[k] or (n and any("\x0c" in x for x in lines[filled[n - 1] + 1 : k])):
                edge |= {*filled[max(0, n - 2) : n + 2]}
    numbers = {k for k in (filled if kind == "pdf" else edge) if is_page_number(lines[k].strip("\x0c "))}
    return filled, edge, numbers


def title_lines(lines: list[str], kind: str | None, filled: list[int], edge: set[int], numbers: set[int]) -> dict[int, tuple[str, str, str]]:
    """The lines that could be running titles, with their parts: at an edge, beside a page number, or anywhere in a pdf."""
    out = {}
    for k in filled:
        near = k in edge or (k - 1 in numbers) or (k + 1 in numbers)
        if k not in numbers and (near or kind == "pdf") and (p := title_parts(lines[k], near)):
            out[k] = p
    return out


def structure(text: str, kind: str | None) -> tuple[bool, list[tuple[str, str, str]], list[tuple[str, str, str, int, bool, bool]]]:
    """(has a page number, breaks as (left, right, mark), titles).

    A title is (key, least number, greatest number, lines, whether a number stands apart, whether one might).
    """
    lines = text.split("\n")
    filled, edge, numbers = page_lines(lines, kind)
    could = title_lines(lines, kind, filled, edge, numbers)
    breaks = []
    for n, k in enumerate(filled):
        if k in numbers or not (left := broken_word(lines[k])):
            continue
        for j in filled[n + 1 :]:
            after = lines[j].lstrip("\x0c ")
            if j in numbers:
                continue
            if after[:1].islower():
                breaks.append((left[0].lower(), _LETTERS.match(after).group().lower(), left[1]))
                break
            if kind != "pdf" or j not in could:  # titles of pages may stand between the halves of a word
                break
    titles: dict[str, list[tuple[str, str]]] = {}
    for key, number, shape in could.values():
        titles.setdefault(key, []).append((number, shape))
    first, out = {p[0] for k, p in could.items() if k in edge}, []
    for key, found in titles.items():
        if len(found) > 1 or key in first:
            numbers_of = [n for n, _ in found]
            out.append((key, min(numbers_of), max(numbers_of), len(found), any(n and s == "lead" for n, s in found), any(n and s == "wide" for n, s in found)))
    return bool(numbers), breaks, out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64)


def _hash(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def words_of(text: str) -> list[str]:
    """The lower-case words of a text; compounds also stand as their parts."""
    out = []
    for w in _WORD.findall(text.lower()):
        out.append(w)
        if "-" in w or "‐" in w:
            out += re.split("[-‐]", w)
    return out


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: compressed files, and rows that are repeated, pass for a fraction of their size in memory."""
    return df.hint("merge")


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """word, pair, n: counts of words (pair null) and of hashed pairs of neighbouring words (word null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids: dict[str, int] = {}
            row: list[int] = []
            for t in b[text]:
                row += [ids.setdefault(w, len(ids)) for w in words_of(t)]
            if not row:
                continue
            x = np.array(row)
            words = list(ids)
            n = np.bincount(x, minlength=len(words))
            pairs, c = np.unique(x[:-1] * len(words) + x[1:], return_counts=True)
            h = _hash(words)
            yield pd.DataFrame({"word": pd.Series(words, dtype=object), "pair": pd.Series([None] * len(words), dtype="Int64"), "n": n})
            if len(pairs):
                yield pd.DataFrame({"word": pd.Series([None] * len(pairs), dtype=object), "pair": pd.Series(_pair(h[pairs // len(words)], h[pairs % len(words)]), dtype="Int64"), "n": c})

    parts = widened(texts).mapInPandas(run, "word string, pair long, n long")
    return parts.groupBy("word", "pair").agg(F.sum("n").alias("n"))


def _skeleton_column(c: Column) -> Column:
    c = F.translate(c, "".join(map(chr, NARROW)), "".join(map(chr, NARROW.values())))
    for a, b in WIDE.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def misread_forms(counts: DataFrame) -> DataFrame:
    """bad, good: rare forms and the far more frequent form of their skeleton group."""
    words = counts.filter("word is not null").select("word", "n", _skeleton_column(F.col("word")).alias("k"))
    words = words.filter(F.col("word").rlike(r"\p{L}") & (F.length("word") >= 2) & ~F.col("word").contains("-"))
    clean = words.filter((F.col("n") >= MIN_GOOD) & F.col("word").rlike(r"^[\p{L}]+$"))
    goods = clean.select("k", F.col("word").alias("good"), F.col("n").alias("n_good"))
    bad = words.join(sorted_side(goods), "k").filter((F.col("word") != F.col("good")) & (F.col("n_good") >= MIN_RATIO * F.col("n")))
    odd = ~F.col("word").rlike(r"^[\p{L}&&[^ſ]]+$")
    bad = bad.filter(odd | (F.length("word") >= 3)).select(F.col("word").alias("bad"), "good", "n_good")

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[confusable(x, y) for x, y in zip(b["bad"], b["good"], strict=True)]]

    bad = bad.mapInPandas(taken, "bad string, good string, n_good long")
    return bad.groupBy("bad").agg(F.max(F.struct("n_good", "good")).alias("g")).select("bad", "g.good")


def _cells(words: list[str], bits: int) -> np.ndarray:
    """(PROBES, words): the bits of each word in a table of 2 ** bits."""
    h, out = _hash(words), []
    for _ in range(PROBES):
        out.append((h & np.uint64((1 << bits) - 1)).astype(np.int64))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.array(out)


def bit_table(forms: DataFrame, column: str, n: int) -> np.ndarray:
    """The bits of so many strings, packed to bytes; the workers put pieces of it together, which are fetched a partition at a time."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(64 * max(n, 1))))))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = _cells(list(b[column]), bits).reshape(-1)
            yield pd.DataFrame({"piece": (cell >> PIECE).astype(np.int32), "bit": (cell & ((1 << PIECE) - 1)).astype(np.int32)})

    def packed(piece: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << PIECE, bool)
        on[piece["bit"].to_numpy()] = True
        return pd.DataFrame({"piece": piece["piece"].iloc[:1], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    cells = forms.select(column).mapInPandas(hashed, "piece int, bit int")
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in cells.groupBy("piece").applyInPandas(packed, "piece int, bits binary").toLocalIterator():
        table[r.piece << (PIECE - 3) : (r.piece + 1) << (PIECE - 3)] = np.frombuffer(r.bits, np.uint8)
    return table


def _hit(table: np.ndarray, words: list[str]) -> list[str]:
    """Those of the words whose bits are all set."""
    if not words:
        return []
    cell = _cells(words, len(table).bit_length() + 2)
    return [words[k] for k in np.flatnonzero(((table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).all(0))]


def _scan(items: DataFrame, table: np.ndarray) -> DataFrame:
    """media_no, post_id, path, what, a, b, c, n, lead, wide: everything that one scan of the texts finds.

    A ``bad`` word is one whose bit is set; whether it is a misread form is left to a join.
    """
    shared = items.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for frame in batches:
            out = []
            cut = [_WORD.findall(t.lower()) for t in frame["extracted_text"]]
            known = {w for ws in cut for w in ws}
            known |= {p for w in known if "-" in w for p in w.split("-")}
            bad = set(_hit(bits, sorted(known)))
            for k, (kind, text, words) in enumerate(zip(frame["media_type"], frame["extracted_text"], cut, strict=True)):
                paged, breaks, titles = structure(text, kind)
                if paged:
                    out.append((k, "page", None, None, None, 1, False, False))
                out += [(k, "break", a, b, m, 1, False, False) for a, b, m in dict.fromkeys(breaks)]
                out += [(k, "line", *t) for t in titles]
                for j, w in enumerate(words):
                    if w in bad:
                        out.append((k, "bad", w, words[j - 1] if j else "", words[j + 1] if j + 1 < len(words) else "", 1, False, False))
                    elif "-" in w:
                        out += [(k, "bad", p, "", "", 1, False, False) for p in w.split("-") if p in bad and not p.isalpha()]
            if not out:
                continue
            got = pd.DataFrame(out, columns=["row", "what", "a", "b", "c", "n", "lead", "wide"])
            at = got.pop("row").to_numpy(np.int64)
            for c in ("path", "post_id", "media_no"):
                got.insert(0, c, frame[c].to_numpy()[at])
            yield got

    return widened(items).mapInPandas(run, "media_no long, post_id string, path long, what string, a string, b string, c string, n long, lead boolean, wide boolean")


class Findings:
    """What the scans of a table of media items found."""

    def __init__(self, media: DataFrame) -> None:
        self.items = media.select("media_no", "post_id", F.xxhash64("media_path").alias("path"), "media_type", "extracted_text").filter(F.length("extracted_text") > 0)
        self.counts = checkpointed(word_counts(self.items.select("extracted_text"), "extracted_text"))
        self.forms = checkpointed(misread_forms(self.counts))
        self.found = checkpointed(_scan(self.items, bit_table(self.forms, "bad", self.forms.count())))

    def misread(self) -> DataFrame:
        """media_no, bad, good: misread words whose restored form stands beside the same neighbour elsewhere."""
        bad = self.found.filter("what = 'bad'").select("media_no", F.col("a").alias("bad"), F.col("b").alias("prev"), F.col("c").alias("next"))
        contexts = bad.select("bad", "prev", "next").distinct().join(sorted_side(self.forms), "bad")

        def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                g = _hash(list(b["good"]))
                for side, h in (("prev", _pair(_hash(list(b["prev"])), g)), ("next", _pair(g, _hash(list(b["next"]))))):
                    yield pd.DataFrame({"bad": b["bad"], "good": b["good"], "pair": h, "given": b[side] != ""})

        needs = contexts.mapInPandas(hashed, "bad string, good string, pair long, given boolean").filter("given").select("bad", "good", "pair").distinct()
        pairs = self.counts.filter("pair is not null").select("pair", F.col("n").alias("pn"))
        supported = needs.join(sorted_side(pairs), "pair").groupBy("bad", "good").agg(F.max("pn").alias("pn")).filter("pn >= 2").select("bad", "good")
        return bad.select("media_no", "bad").distinct().join(sorted_side(supported), "bad")

    def hyphens(self) -> DataFrame:
        """media_no, left, right: words split at a line or page end by a mark that isn't their own."""
        b = self.found.filter("what = 'break'").select("media_no", F.col("a").alias("left"), F.col("b").alias("right"), F.col("c").alias("mark"))
        pairs = b.select("left", "right", "mark").distinct()
        words = self.counts.filter("word is not null").select("word", "n")
        for name, c in (("joined", F.concat("left", "right")), ("kept", F.concat("left", F.lit("-"), "right")), ("alone_l", F.col("left")), ("alone_r", F.col("right"))):
            pairs = pairs.withColumn("word", c).join(sorted_side(words.withColumnRenamed("n", name)), "word", "left").drop("word").na.fill(0, [name])
        own = F.when(F.col("mark").isin(*_MARKS_OF_BREAKS), False).when(F.col("kept") >= F.greatest(F.col("joined"), F.lit(1)), True)
        own = own.when(F.col("joined") > 0, False).otherwise((F.col("alone_l") >= 5) & (F.col("alone_r") >= 5))
        return b.join(sorted_side(pairs.filter(~own).select("left", "right", "mark")), ["left", "right", "mark"])

    def titles(self) -> DataFrame:
        """media_no, key, numbered: running titles of items, and whether a page number stands in them."""
        lines = self.found.filter("what = 'line'").select("media_no", "post_id", "path", F.col("a").alias("key"), F.col("b").alias("least"), F.col("c").alias("most"), "n", "lead", "wide")
        lines = lines.withColumn("place", F.coalesce("post_id", F.concat(F.lit("item "), F.col("media_no").cast("string"))))
        paths = lines.groupBy("place", "key", "path").agg(F.max("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        groups = paths.groupBy("place", "key").agg(F.sum("n").alias("lines"), (F.min("least") != F.max("most")).alias("varies"))
        groups = groups.withColumn("make", F.concat_ws(" ", F.element_at(F.split("key", " "), 1), F.element_at(F.split("key", " "), -1)))
        makes = groups.groupBy("make").agg(F.count("*").alias("all"), F.sum(F.when(F.col("lines") > 1, 1).otherwise(0)).alias("again"))
        makes = makes.filter(F.col("again") >= RECURRING * (F.col("all") + 2)).select("make")
        running = checkpointed(groups.filter("lines > 1").join(makes, "make").select("place", "key", "varies"))
        # a title of a post with a third of all items is one key: its lines are spread, its one row is repeated
        running = running.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hits = lines.withColumn("salt", F.pmod("media_no", F.lit(SALT)).cast("int")).join(sorted_side(running), ["place", "key", "salt"])
        return hits.groupBy("media_no", "key").agg(F.max(F.col("lead") | (F.col("wide") & F.col("varies"))).alias("numbered"))

    def defects(self) -> DataFrame:
        """media_no, defect: one row for each defect that occurs in an item."""
        titles = self.titles()
        case = lambda df, d: df.select("media_no", F.lit(d).alias("defect"))
        out = case(self.misread(), "misread").unionByName(case(self.hyphens(), "hyphenation")).unionByName(case(titles, "header"))
        out = out.unionByName(case(titles.filter("numbered"), "page_number")).unionByName(case(self.found.filter("what = 'page'"), "page_number"))
        return out.distinct()


def repaired(media: DataFrame) -> DataFrame:
    """media_no, paragraphs: each item's text as continuous paragraphs without the traces of scanning.

    Every item comes out: a null text as null, an empty one, or one of nothing but page numbers and titles, as empty.
    """
    f = Findings(media)
    marks = f.misread().groupBy("media_no").agg(F.map_from_entries(F.collect_set(F.struct("bad", "good"))).alias("fix"))
    joins = f.hyphens().groupBy("media_no").agg(F.collect_set(F.concat_ws("\x01", "left", "right")).alias("joins"))
    heads = f.titles().groupBy("media_no").agg(F.collect_set("key").alias("heads"))
    items = f.items.select("media_no", "media_type", "extracted_text").join(marks, "media_no", "left").join(joins, "media_no", "left").join(heads, "media_no", "left")

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for no, kind, text, fix, split, head in zip(b["media_no"], b["media_type"], b["extracted_text"], b["fix"], b["joins"], b["heads"], strict=True):
                fix = dict(fix) if fix is not None else {}
                split, head = set(split if split is not None else ()), set(head if head is not None else ())
                lines = text.split("\n")
                filled, edge, numbers = page_lines(lines, kind)
                titles = title_lines(lines, kind, filled, edge, numbers) if head else {}

                def right(m: re.Match, fix: dict = fix) -> str:
                    w = m.group()
                    g = fix.get(w.lower())
                    if g is None and "-" in w:
                        return "-".join(fix.get(p.lower(), p) if not p.isalpha() else p for p in w.split("-"))
                    return w if g is None else g.upper() if w.isupper() and len(w) > 1 else g.capitalize() if w[:1].isupper() else g

                for k, line in enumerate(lines):
                    bare = line.strip("\x0c ")
                    drop = k in numbers or (k in titles and titles[k][0] in head)
                    out.append((no, k, "drop" if drop else "blank" if not bare else "text", _WORD.sub(right, bare) if fix else bare, "\x02".join(sorted(split))))
            if out:
                yield pd.DataFrame(out, columns=["media_no", "line", "what", "text", "splits"])

    lines = items.mapInPandas(classify, "media_no long, line long, what string, text string, splits string").filter("what <> 'drop'")
    by = W.partitionBy("media_no").orderBy("line")
    lines = lines.withColumn("prev", F.lag("what").over(by)).withColumn("before", F.last(F.when(F.col("what") == "text", F.col("text")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    goes_on = ~F.coalesce(F.col("before"), F.lit(".")).rlike(r"[.!?:…][)\"'”]?$") & F.substring("text", 1, 1).rlike(r"\p{Ll}|[\p{L}\p{N}(]")
    new = F.col("before").isNull() | ((F.col("prev") == "blank") & ~(goes_on & F.col("text").rlike(r"^\p{Ll}"))) | F.col("text").rlike(r"^[-•*] ")
    text = lines.filter("what = 'text'").withColumn("para", F.sum(F.when(new, 1).otherwise(0)).over(by))
    left = F.lower(F.regexp_extract(F.coalesce("before", F.lit("")), r"(\p{L}+)[-‐¬­=]\s*$", 1))
    right = F.lower(F.regexp_extract("text", r"^(\p{L}+)", 1))
    glue = (left != "") & F.array_contains(F.split("splits", "\x02"), F.concat_ws("\x01", left, right))
    own = (left != "") & ~glue
    text = text.withColumn("join", F.when(glue, "g").when(own, "o").otherwise("s"))
    paras = text.groupBy("media_no", "para").agg(F.array_sort(F.collect_list(F.struct("line", "join", "text"))).alias("ls"))

    def add(acc: Column, x: Column) -> Column:
        return (
            F.when(acc == "", x["text"]).when(x["join"] == "g", F.concat(F.regexp_replace(acc, r"[-‐¬­=]\s*$", ""), x["text"]))
            .when(x["join"] == "o", F.concat(acc, x["text"])).otherwise(F.concat(acc, F.lit(" "), x["text"]))
        )

    paras = paras.select("media_no", "para", F.aggregate("ls", F.lit(""), add).alias("p"))
    texts = paras.groupBy("media_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "p"))), lambda x: x["p"]), "\n\n").alias("paragraphs"))
    every = media.select("media_no", F.when(F.col("extracted_text").isNotNull(), "").alias("none"))
    return every.join(texts, "media_no", "left").select("media_no", F.coalesce("paragraphs", "none").alias("paragraphs"))


def scan_defects(media: DataFrame) -> DataFrame:
    """media_no, defect of every item."""
    return Findings(media).defects()
