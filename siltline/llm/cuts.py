"""Text values that were cut off, by a backward character n-gram model.

For the last characters of a value (contexts of growing length, read backward from its end) the model
knows how often they are followed by an end (the end of a value or of a paragraph, or a finished sentence)
and how often the text runs on. The two are interpolated from short contexts to long ones, the
value's own end left out, into the log-odds of an end. The threshold on the log-odds is found per language and
column, at the widest gap of their histogram.

Counting is a scan with vectorised rolling hashes: the final contexts of all values form a bit table of
fixed size that is sent to the workers, so only contexts that some value ends in are counted, summed per batch
and then shuffled.

Defined results: null and blank values are no case and give no row; what a source puts behind a cut
(dots, "see more", a replacement character) is taken off first; deliberate dots do not make a case;
equal values are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.llm.lookalikes import Rewriter
from siltline.llm.pairs import LANGUAGES, LANGUAGES_OF
from siltline.session import checkpointed, widened

SIZES = (3, 5, 8, 12)  # characters of the contexts
PRIOR = 2.0  # weight of the shorter context's estimate
BITS = 22  # the bit table of final contexts has 2**BITS bytes at most
LOWEST, HIGHEST = -5.0, -1.0  # the threshold on the log-odds lies between these
TITLE_SHARE = 0.2  # values of an opening that hardly ever closes with a full stop are titles
_CLOSERS = tuple(".!?…\"')”»")
_BASE = np.uint64(0x9E3779B97F4A7C15)
# What sources put behind a cut.
_TAIL = re.compile(r"(?:\s*(?:\(?(?:\.{3}|…)?\s*(?:see|read|show|view)?\s*more\)?|\[(?:\.{3}|…)\]|\.{3}|…|�|\\+|<\w*|&\w*|\[?truncated\]?|mehr anzeigen|voir plus|ver más))+\s*$", re.I)
_CLOSING = r"([\p{L}\p{N}_]+)[\"'”’»)\]]*[.!?](?:\s|$)"
_WINDOW = 48  # longer than any one thing that a source puts behind a cut, but for an open tag or entity
_OPEN_TAG = frozenset("<&")
_NUMBER = re.compile(r"\d[\d,.]*\d|\d")
_rewrite: list[Rewriter] = []


def plain(text: str) -> str:
    """The text with its look-alikes unified and every number shortened to one digit."""
    if not text.isascii():
        if not _rewrite:
            _rewrite.append(Rewriter({c: 1 for c in map(chr, range(32, 127))}))
        text = _rewrite[0](text)
    return _NUMBER.sub("0", text.replace("\x00", " "))


def bare_end(text: str) -> str:
    """The plain text without what a source put behind a cut, however often it stands there."""
    text = plain(text).rstrip()
    while text:
        low = max(0, len(text) - _WINDOW)
        m = _TAIL.search(text, low)
        if m and m.start() == low and low:  # more of the same before the window
            m = _TAIL.search(text, max(0, low - 20 * _WINDOW)) or m
        if m:
            text = text[: m.start()].rstrip()
            continue
        word = len(text)
        while word and (text[word - 1].isalnum() or text[word - 1] == "_"):
            word -= 1
        if not word or text[word - 1] not in _OPEN_TAG:
            break
        text = text[: word - 1].rstrip()
    return text


def language(text: str) -> str:
    """The language with most small words in the text, or an empty string; ties go to the first of LANGUAGES."""
    votes = [0] * len(LANGUAGES)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in LANGUAGES_OF:
            for k in LANGUAGES_OF[w]:
                votes[k] += 1
    best = max(votes)
    return LANGUAGES[votes.index(best)] if best else ""


def opener(text: str) -> str | None:
    """The first two words of a value that is one unbroken line without a sentence end inside."""
    if "\n" in text or re.search(r"[.!?…]\s", text):
        return None
    return " ".join(text.lower().split()[:2]) or None


def last_word(text: str) -> str | None:
    """The last word of a value, in lower case."""
    words = re.findall(r"\w+", text[-200:].lower())
    return words[-1] if words else None


def closing_words(values: DataFrame) -> DataFrame:
    """last: the different words that stand before the full stop of a sentence; dots behind a cut close none."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_CLOSING), F.lit(1)))
    return values.select(word.alias("w")).select(F.regexp_replace("w", r"[0-9]+", "0").alias("last")).distinct()


def _mix(h: np.ndarray, size: int) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def final_hashes(ends: list[str]) -> dict[int, pd.Series]:
    """The hash of the last characters of each text, for every size of context; null where the text is shorter."""
    most = SIZES[-1]
    codes = np.array([e[-most:].rjust(most, "\x00") for e in ends], dtype=f"<U{most}").view(np.uint32).reshape(len(ends), most).astype(np.uint64) if ends else np.zeros((0, most), np.uint64)
    # a trailing zero would be lost in a string array, but no text ends in one: it is blank and stripped before
    long = np.array([len(e) for e in ends], dtype=np.int64)
    out = {}
    for s in SIZES:
        h = np.zeros(len(ends), np.uint64)
        for k in range(most - s, most):
            h = h * _BASE + codes[:, k] + np.uint64(1)
        out[s] = pd.Series(_mix(h, s).astype(np.int64), dtype="Int64").mask(pd.Series(long < s))
    return out


_STOP = np.array([ord(c) for c in ".!?…"], np.uint64)
_SPACE = np.array([ord(c) for c in " \n"], np.uint64)


def _ends(codes: np.ndarray) -> np.ndarray:
    """Whether each position 1..len(codes) is an end: of the value, a paragraph, a finished sentence or a tag."""
    after = np.empty(len(codes), np.uint64)
    after[:-1], after[-1] = codes[1:], 10
    after[after == 0] = 10  # values of a batch stand behind one another
    then = np.zeros(len(codes), np.uint64)
    then[:-2] = codes[2:]
    sentence = np.isin(codes, _STOP) & np.isin(after, _SPACE)
    return (after == 10) | sentence | ((after == 32) & (then == 35))


def joined(b: pd.DataFrame, most: int = 500_000) -> Iterator[tuple[str, np.ndarray]]:
    """(field, codes) of the values of a batch, one behind another with a zero between, about ``most`` characters at a time."""
    for field, texts in b.groupby("field")["text"]:
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(bare_end(t))
            size += len(part[-1])
            if size > most:
                yield field, _codes("\x00".join(part))
                part, size = [], 0
        if size:
            yield field, _codes("\x00".join(part))


def value_ends(df: DataFrame, key: str, columns: dict[str, Column], platform: Column) -> DataFrame:
    """One row for each non-blank value: key, field, platform, text."""
    each = F.array(*[F.struct(F.lit(k).alias("field"), c.alias("text")) for k, c in columns.items()])
    out = df.select(F.col(key).alias("row"), platform.alias("platform"), F.explode(each).alias("v")).select("row", "platform", "v.field", "v.text")
    return out.filter(F.col("text").rlike(r"\S"))


def score_ends(values: DataFrame) -> DataFrame:
    """row, platform, field, lang, odds (log-odds of an end) and the threshold of language and column.

    ``values`` has row, platform, field, text.
    """
    spark = values.sparkSession
    hs = [f"h{s}" for s in SIZES]

    def finals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [bare_end(t) for t in b["text"]]
            got = pd.DataFrame({f"h{k}": v for k, v in final_hashes(ends).items()})
            got["row"], got["platform"], got["field"] = b["row"].to_numpy(), b["platform"].to_numpy(), b["field"].to_numpy()
            got["lang"] = [language(t) for t in b["text"]]
            got["opener"] = [opener(e) for e in ends]
            got["closed"] = [int(e[-1:] in _CLOSERS) for e in ends]
            got["own"] = [int(bool(e)) for e in ends]
            got["last"] = [last_word(e) for e in ends]
            got["end_hash"] = pd.util.hash_array(np.array(ends, dtype=object), categorize=False).astype(np.int64)
            got["text_hash"] = b["text_hash"].to_numpy()
            yield got[["row", "platform", "field", "lang", "own", "opener", "closed", "last", "end_hash", "text_hash", *hs]]

    kind = values.schema["row"].dataType.simpleString()
    hashed = values.withColumn("text_hash", F.xxhash64("text"))
    final = checkpointed(widened(hashed).mapInPandas(finals, f"row {kind}, platform string, field string, lang string, own int, opener string, closed int, last string, end_hash long, text_hash long, " + ", ".join(f"{h} long" for h in hs)))
    distinct = final.select("field", F.explode(F.array(*hs)).alias("h")).filter("h is not null").select(F.pmod("h", F.lit(1 << (BITS + 3))).alias("b")).distinct()
    # the table of final contexts as bytes: each task builds its part, the parts have a fixed total size
    table = np.zeros(1 << BITS, np.uint8)
    packed = distinct.select(F.floor(F.col("b") / 8).cast("int").alias("at"), F.expr("shiftleft(1, cast(b % 8 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    got = packed.toPandas()
    table[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for b in batches:
            for field, codes in joined(b):
                end, at = _ends(codes), np.arange(len(codes))
                since = at - np.maximum.accumulate(np.where(codes == 0, at, -1))  # characters of the value up to each position
                h = np.zeros(len(codes), np.uint64)
                for k in range(SIZES[-1]):
                    h = h[: len(codes) - k] * _BASE + codes[k:] + np.uint64(1)
                    s = k + 1
                    if s not in SIZES:
                        continue
                    mixed = _mix(h, s)
                    cell = (mixed & np.uint64((1 << (BITS + 3)) - 1)).astype(np.int64)
                    keep = ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0) & (since[k:] >= s)
                    if not keep.any():
                        continue
                    u, inv = np.unique(mixed[keep], return_inverse=True)
                    e = np.bincount(inv, end[k:][keep], len(u)).astype(np.int64)
                    n = np.bincount(inv, minlength=len(u))
                    yield pd.DataFrame({"field": field, "h": u.astype(np.int64), "n_end": e, "n_all": n})

    counts = widened(values.select("field", "text")).mapInPandas(count, "field string, h long, n_end long, n_all long")
    counts = checkpointed(counts.groupBy("field", "h").agg(F.sum("n_end").alias("n_end"), F.sum("n_all").alias("n_all")))  # used twice
    # distinct endings are joined to the counts, then the rows to the endings
    endings = final.groupBy("field", *hs).agg(F.count("*").alias("copies"))
    endings = endings.withColumn("e_id", F.xxhash64("field", *hs))
    need = endings.select("e_id", "field", F.posexplode(F.array(*hs)).alias("k", "h")).filter("h is not null")
    need = need.join(counts, ["field", "h"], "left").groupBy("e_id").pivot("k", list(range(len(SIZES)))).agg(F.first("n_end").alias("e"), F.first("n_all").alias("a"))
    copies = final.groupBy("field", "text_hash").agg(F.count("*").alias("copies"))
    copies = copies.filter("copies > 1")
    # different texts of an opener are counted, not rows: copies of one cut text make no title
    texts = final.filter("opener is not null").groupBy("field", "opener", "end_hash").agg(F.max("closed").alias("closed"))
    openers = texts.groupBy("field", "opener").agg(F.count("*").alias("o_n"), F.sum("closed").alias("o_closed"))
    titles = openers.filter((F.col("o_n") >= 3) & (F.col("o_closed") < TITLE_SHARE * F.col("o_n"))).select("field", "opener")
    # and a title is whole only if its last word closes a sentence somewhere
    whole = final.filter("opener is not null").join(titles, ["field", "opener"]).select("field", "opener", "last").distinct()
    titles = whole.join(closing_words(values), "last", "left_semi").withColumn("title", F.lit(True))
    total = counts.agg((F.sum("n_end") / F.sum("n_all")).alias("base"))
    scored = final.withColumn("e_id", F.xxhash64("field", *hs)).join(need, "e_id", "left").join(copies, ["field", "text_hash"], "left")
    # most values have no opener: each gets a key of its own that no title has, so they don't all meet in one task
    scored = scored.withColumn("opener", F.coalesce("opener", F.concat(F.lit("\n"), F.col("row").cast("string"))))
    scored = scored.join(titles, ["field", "opener", "last"], "left").crossJoin(F.broadcast(total))  # total is one row
    own = F.col("own") * F.coalesce("copies", F.lit(1))
    p = F.coalesce(F.col("base"), F.lit(0.05))
    for k in range(len(SIZES)):
        e = F.greatest(F.coalesce(F.col(f"{k}_e"), F.lit(0)) - own, F.lit(0))
        a = F.greatest(F.coalesce(F.col(f"{k}_a"), F.lit(0)) - own, F.lit(0))
        p = (e + PRIOR * p) / (a + PRIOR)
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = scored.select("row", "platform", "field", "lang", F.coalesce("title", F.lit(False)).alias("title"), F.log(p / (1 - p)).alias("odds"))
    scored = checkpointed(scored)
    return scored.join(F.broadcast(thresholds(scored)), ["field", "lang"])


def thresholds(scored: DataFrame, step: float = 0.1) -> DataFrame:
    """field, lang, threshold: the middle of the widest stretch between LOWEST and HIGHEST with the fewest values."""
    cells = F.floor(F.col("odds") / step).cast("int")
    histogram = scored.groupBy("field", "lang", cells.alias("cell")).agg(F.count("*").alias("n")).filter(F.col("cell").between(int(LOWEST / step) - 1, int(HIGHEST / step) + 1))
    groups = scored.select("field", "lang").distinct()  # columns times languages
    counts = {(r.field, r.lang, r.cell): r.n for r in histogram.collect()}
    rows = []
    for g in groups.collect():
        cells_, best = range(round(LOWEST / step), round(HIGHEST / step)), None
        for w in range(len(cells_), 2, -1):
            for i in range(len(cells_) - w + 1):
                mass = sum(counts.get((g.field, g.lang, c), 0) for c in cells_[i : i + w])
                cost = mass - 0.25 * w
                if best is None or cost < best[0]:
                    best = (cost, (cells_[i] + w / 2) * step)
        rows.append((g.field, g.lang, float(best[1])))
    return scored.sparkSession.createDataFrame(rows, "field string, lang string, threshold double")


def post_values(posts: DataFrame) -> DataFrame:
    """The two columns of posts whose values may be cut."""
    return value_ends(posts, "row_no", {"original_text": F.col("original_text"), "summary": F.col("ai_analysis.summary")}, F.col("source.platform"))


def cut_values(posts: DataFrame) -> DataFrame:
    """row_no, field, platform, cut of every non-blank value."""
    s = score_ends(post_values(posts))
    return s.select(F.col("row").alias("row_no"), "field", "platform", "lang", "odds", "threshold", ((F.col("odds") < F.col("threshold")) & ~F.col("title")).alias("cut"))
