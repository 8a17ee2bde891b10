"""Freely typed labels to the entries of a reference list, by BK-trees.

Every reference entry stands in the tree under a few written forms (term, aliases, singular words, words in
sorted order). The tree's metric is the Levenshtein distance, so pruning by the triangle inequality
returns every form within the threshold; hits are ranked by the unrestricted Damerau distance. A reference list of at most
``BROADCAST_TERMS`` entries is shipped to the workers as one tree; a longer one is cut into shards, each
different label of the data is searched in every shard, by tasks of about PART_LABELS labels, and the winners of the
shards are merged. The list is counted before anything is broadcast.

Defined results: a null or blank label is no case and gives no row; a label as near to two different
terms as to its best one, or farther than the threshold from all, gives term id 0; an empty reference
gives 0 throughout; repeated labels are separate rows; reference rows with null terms are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.session import checkpointed, out_schema, widened

BROADCAST_TERMS = 50_000  # entries of one tree; a longer list is cut into shards
PART_LABELS = 20_000  # different labels that one task searches in one shard, about
UNMATCHED = 0
# Words around a label that carry no meaning of their own, at its start and at its end.
LEADING = ["introduction to", "intro to", "an introduction to", "basics of", "advanced", "about", "the", "a", "an", "on", "more on", "learning", "understanding"]
TRAILING = ["for beginners", "in practice", "in a nutshell", "in depth", "deep dive", "explained", "basics", "tutorial", "tips and tricks", "tips", "advanced", "101", "etc", "and more", "stuff"]
_LEAD = re.compile(r"^(?:" + "|".join(LEADING) + r")\s+(?=\S)")
_TRAIL = re.compile(r"\s+(?:" + "|".join(TRAILING) + r")$")


def threshold(length: int) -> int:
    """Edits allowed for a written form of so many characters."""
    return 0 if length <= 4 else 1 if length <= 6 else 2


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance (Lowrance and Wagner), which obeys the triangle inequality."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n or m
    last: dict[str, int] = {}
    top = n + m
    d = [[top] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        match, ca = 0, a[i - 1]
        row, above = d[i + 1], d[i]
        for j in range(1, m + 1):
            k, l_ = last.get(b[j - 1], 0), match
            cost = 1
            if ca == b[j - 1]:
                cost, match = 0, j
            best = above[j] + cost
            if row[j] + 1 < best:
                best = row[j] + 1
            if above[j + 1] + 1 < best:
                best = above[j + 1] + 1
            swap = d[k][l_] + (i - k - 1) + 1 + (j - l_ - 1)
            row[j + 1] = swap if swap < best else best
        last[ca] = i
    return d[n + 1][m + 1]


class Pattern:
    """One string, to take Levenshtein distances from by Myers' bit vectors."""

    def __init__(self, text: str) -> None:
        self.text, self.n = text, len(text)
        self.mask, self.top = (1 << self.n) - 1, 1 << max(0, self.n - 1)
        self.at: dict[str, int] = {}
        for k, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | 1 << k

    def distance(self, other: str) -> int:
        """Levenshtein distance to ``other``."""
        if not self.n:
            return len(other)
        pv, mv, score, mask, top, get = self.mask, 0, self.n, self.mask, self.top, self.at.get
        for c in other:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & top:
                score += 1
            if mh & top:
                score -= 1
            ph = ph << 1 | 1
            pv = (mh << 1 | ~(xv | ph)) & mask
            mv = ph & xv & mask
        return score


class BKTree:
    """Strings with sets of payloads, searched by radius in the Levenshtein metric."""

    def __init__(self) -> None:
        self.root: list | None = None  # [string, payloads, {distance: child}]
        self.exact: dict[str, set] = {}

    def add(self, text: str, payload: int) -> None:
        if text in self.exact:
            self.exact[text].add(payload)
            return
        self.exact[text] = {payload}
        node = [text, self.exact[text], {}]
        if self.root is None:
            self.root = node
            return
        at, pattern = self.root, Pattern(text)
        while True:
            d = pattern.distance(at[0])
            if d not in at[2]:
                at[2][d] = node
                return
            at = at[2][d]

    def within(self, text: str, radius: int) -> list[tuple[int, set]]:
        """(Damerau distance, payloads) of every string whose Damerau distance is within the radius.

        A transposition costs two in the tree's metric, so the tree is searched by twice the radius.
        """
        out, todo, pattern, wide = [], [self.root] if self.root else [], Pattern(text), 2 * radius
        while todo:
            s, payloads, children = todo.pop()
            d = pattern.distance(s)
            if d <= wide and radius <= 2 * threshold(len(s)):
                e = edit_distance(text, s) if d > 1 else d
                if e <= min(radius, threshold(len(s))):
                    out.append((e, payloads))
            todo += [c for k, c in children.items() if d - wide <= k <= d + wide]
        return out


def words_of(label: str) -> list[str]:
    """The words of a label: compatibility forms, no invisible characters, case and punctuation folded away."""
    t = unicodedata.normalize("NFKC", label)
    t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Mn") or c == "́")
    if t.lstrip().startswith("#"):
        t = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", t)
    t = re.sub(r"\b(?:\w\.){2,}", lambda m: m.group().replace(".", ""), t)
    return re.sub(r"[\W_]+", " ", t.casefold()).split()


def forms_of(words: list[str]) -> list[tuple[str, str]]:
    """(kind, form) of a label's words: as written, with singular words, and with its words sorted."""
    single = [w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w[:-1] if w.endswith("s") and len(w) > 4 else w for w in words]
    out = [("n", "".join(words)), ("p", "".join(single))]
    if len(words) > 1:
        out.append(("s", "".join(sorted(words))))
    return out


def stripped(words: list[str]) -> list[str]:
    """The words without what stands around a label."""
    t, before = " ".join(words), None
    while t != before:
        before = t
        t = _TRAIL.sub("", _LEAD.sub("", t))
    return t.split()


class Matcher:
    """Search in the trees of one shard of the reference list."""

    def __init__(self, rows: list[tuple[int, str, str, list[str] | None]]) -> None:
        self.trees: dict[tuple[str, str], BKTree] = {}
        self.initials: dict[tuple[str, str], set[int]] = {}
        for term_id, kind, term, aliases in sorted(rows, key=lambda r: r[0]):
            for k, name in enumerate([term, *(aliases or [])]):
                if not name or not (w := words_of(name)):
                    continue
                for form, text in forms_of(w):
                    self.trees.setdefault((kind, form), BKTree()).add(text, term_id)
                if k == 0 and len(w) > 2:
                    self.initials.setdefault((kind, "".join(x[0] for x in w)), set()).add(term_id)

    def candidates(self, kind: str, label: str) -> list[tuple[int, int]]:
        """(distance, term_id) of every entry within the threshold of its length."""
        words = words_of(label)
        if not words:
            return []
        bare = stripped(words)
        queries = {*forms_of(words), *(forms_of(bare) if bare else [])}
        best: dict[int, int] = {}
        for form, text in queries:
            tree = self.trees.get((kind, form))
            if tree and text in tree.exact:
                for t in tree.exact[text]:
                    best[t] = 0
        if len(words) == 1 and len(words[0]) > 2:
            for t in self.initials.get((kind, words[0]), ()):
                best[t] = 0
        if not best:
            for form, text in sorted(queries):
                tree, r = self.trees.get((kind, form)), 0 if form == "p" else threshold(len(text))
                if tree and r:
                    for d, terms in tree.within(text, r):
                        for t in terms:
                            best[t] = min(d, best.get(t, d))
        return sorted((d, t) for t, d in best.items())


def _winner(found: list[tuple[int, int]]) -> int:
    if not found or (len(found) > 1 and found[0][0] == found[1][0]):
        return UNMATCHED
    return found[0][1]


def label_entries(posts: DataFrame) -> DataFrame:
    """row_no, field, kind, pos, label of every entry of the three label arrays that is neither null nor blank."""
    arrays = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.col(f"ai_analysis.{f}").alias("labels"))
        for f, k in (("topics", "topic"), ("subtopics", "subtopic"), ("concepts", "concept"))
    ])
    each = posts.select("row_no", F.explode(arrays).alias("a")).select("row_no", "a.field", "a.kind", F.posexplode("a.labels").alias("pos", "label"))
    return each.filter(F.col("label").isNotNull() & F.col("label").rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]")).withColumn("pos", F.col("pos").cast("long"))


def shards_of(reference: DataFrame) -> int:
    """Into how many parts a reference list is cut; one part is broadcast."""
    return max(1, -(-reference.count() // BROADCAST_TERMS))


def match_labels(entries: DataFrame, reference: DataFrame, shards: int | None = None) -> DataFrame:
    """Add ``term_id`` to rows with the columns ``kind`` and ``label``.

    ``reference`` has term_id, kind, term, aliases. ``shards``: cut the reference list into so many parts;
    by default one tree where the list has at most BROADCAST_TERMS entries.
    """
    reference = reference.select("term_id", "kind", "term", "aliases").filter(F.col("term").isNotNull() & F.col("kind").isNotNull())
    shards = shards_of(reference) if shards is None else shards
    if shards == 1:
        rows = [(r.term_id, r.kind, r.term, list(r.aliases or [])) for r in reference.collect()]
        schema = out_schema(entries, term_id="long")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(rows)
            find = functools.lru_cache(maxsize=200_000)(lambda kind, label: _winner(matcher.candidates(kind, label)))
            for b in batches:
                yield b.assign(term_id=[find(k, v) for k, v in zip(b["kind"], b["label"], strict=True)])

        return widened(entries).mapInPandas(run, schema)

    # every different label meets every shard; a shard is searched by as many tasks as its labels need
    typed = checkpointed(entries.select("kind", "label").distinct())
    parts_of = max(1, -(-typed.count() // PART_LABELS))
    typed = typed.withColumn("part", F.pmod(F.xxhash64("kind", "label"), F.lit(parts_of)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = reference.withColumn("shard", F.pmod(F.xxhash64("term_id"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_of - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        matcher = Matcher([(r.term_id, r.kind, r.term, None if r.aliases is None else list(r.aliases)) for r in right.itertuples()])
        out = [(k, v, d, t) for k, v in zip(left["kind"], left["label"], strict=True) for d, t in matcher.candidates(k, v)]
        return pd.DataFrame(out, columns=["kind", "label", "d", "t"])

    found = typed.groupBy("shard", "part").cogroup(parts.groupBy("shard", "part")).applyInPandas(search, "kind string, label string, d int, t long")
    best = F.array_sort(F.collect_set(F.struct("d", "t")))
    won = found.groupBy("kind", "label").agg(best.alias("b"))
    tie = (F.size("b") > 1) & (F.get("b", F.lit(0))["d"] == F.get("b", F.lit(1))["d"])
    won = won.select("kind", "label", F.when(tie, F.lit(UNMATCHED)).otherwise(F.col("b")[0]["t"]).cast("long").alias("won"))
    names = [F.col(f"`{c}`") for c in entries.columns]
    return entries.join(won, ["kind", "label"], "left").select(*names, F.coalesce("won", F.lit(UNMATCHED).cast("long")).alias("term_id"))


def typed_labels(posts: DataFrame, reference: DataFrame, shards: int | None = None) -> DataFrame:
    """row_no, field, pos, label, term_id of every label that isn't written exactly as a term of its kind."""
    shards = shards_of(reference) if shards is None else shards
    exact = reference.select(F.col("kind").alias("k"), F.col("term").alias("t")).distinct()
    written = (F.col("kind") == F.col("k")) & (F.col("label") == F.col("t"))
    entries = label_entries(posts).join(F.broadcast(exact) if shards == 1 else exact, written, "left_anti")  # one shard: at most BROADCAST_TERMS rows
    return match_labels(entries, reference, shards).select("row_no", "field", "pos", "label", "term_id")
