"""Personal data in free text, by a linear-chain conditional random field over word shapes.

The field is trained by gradient ascent on the exact log-likelihood (forward-backward in numpy) from the small
table of ``labelled``, which shares no sentence, name, host, road or town with the texts that are tagged. Words of a run
of numbers also carry the layout of the run (the lengths of its numbers and what stands between them). Workers decode by Viterbi in numpy batches: every distinct word's scores are worked
out once, so a batch costs a few gathers and one vectorised recursion. A check of the written form follows each
piece found (an e-mail address needs a host with a dot, a phone number seven digits, ...).

Defined results: null and empty texts have no pieces and stay as they are; positions count Unicode
characters of the text as stored; pieces never overlap; repeated rows are treated apart.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.labelled import GIVEN, labelled_texts
from siltline.llm.lookalikes import Rewriter
from siltline.session import out_schema, widened

KINDS = ["email", "phone", "id_number", "address", "person"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
TRAINING_TEXTS = 6000  # rows of the labelled table
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
WORDS_KEPT = 60_000  # distinct words whose scores a worker holds
_PIECES = re.compile(r"\w+|[^\w\s]|\s+")
_RUN = re.compile(r"[(+]*\d[\d().,+/-]*(?:\s[(+]*\d[\d().,+/-]*)*")
_TIE = "\x00"  # between a word and the layout of the run of numbers that it stands in
_GIVEN = frozenset(g.lower() for g in GIVEN)


def word_features(w: str) -> list[str]:
    """What a word shows: itself, its shape, its endings, whether it is a given name, and its run of numbers."""
    w, _, run = w.partition(_TIE)
    low = w.lower()
    shape = re.sub(r"\d", "d", re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", w))
    short = re.sub(r"(x)x+|(X)X+", lambda m: m.group(1) or m.group(2), shape)
    out = ["w=" + low, "s=" + short[:12], "f=" + (shape if len(shape) <= 9 else shape[:3] + "+" + str(min(len(shape), 16)))]
    if low.isalpha():
        out += ["e3=" + low[-3:], "e4=" + low[-4:], "p2=" + low[:2]] if len(low) > 3 else []
        if low in _GIVEN:
            out.append("given")
    elif low.isdigit():
        out.append("d=" + str(min(len(low), 10)))
        if len(low) > 1:
            out.append("d0=" + low[0] + str(min(len(low), 10)))
    elif len(low) > 1:
        out.append("mixed")
    if run:
        out.append("r=" + run)
    return out


def layout(run: str) -> str:
    """How a run of numbers is laid out: the lengths of its numbers and what stands between them."""
    return re.sub(r"\s", " ", re.sub(r"\d+", lambda m: str(min(m.end() - m.start(), 10)), run.rstrip("().,+/-")))


def pieces(text: str) -> tuple[list[str], np.ndarray]:
    """The words and signs of a text and where they start."""
    parts = _PIECES.findall(text)
    starts = np.zeros(len(parts), np.int64)
    if parts:
        np.cumsum([len(p) for p in parts[:-1]], out=starts[1:])
    keep = [k for k, p in enumerate(parts) if not p.isspace()]
    words, starts = [parts[k] for k in keep], starts[keep]
    for m in _RUN.finditer(text):
        lo, hi = np.searchsorted(starts, m.span())
        tie = _TIE + layout(m.group())
        for k in range(lo, hi):
            words[k] += tie
    return words, starts


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis)
    return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis))


class Field:
    """A trained field: feature weights by offset, transitions and starts."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray) -> None:
        self.index, self.weights, self.moves, self.first = index, weights, moves, first

    def scores(self, word: str) -> np.ndarray:
        """(offset, label) scores of one word."""
        ids = [i for f in word_features(word) if (i := self.index.get(f)) is not None]
        return self.weights[:, ids].sum(1) if ids else np.zeros((len(OFFSETS), len(LABELS)), np.float32)


def _encode(table: list[tuple[str, list[tuple[int, int, str]]]]) -> tuple[list[list[str]], list[list[int]]]:
    words, labels = [], []
    at = {name: k for k, name in enumerate(LABELS)}
    for text, spans in table:
        ws, starts = pieces(text)
        ls = []
        for s in starts:
            hit = next(((a, k) for a, b, k in spans if a <= s < b), None)
            ls.append(at["O"] if hit is None else at[("B-" if s == hit[0] else "I-") + hit[1]])
        words.append(ws)
        labels.append(ls)
    return words, labels


def train(table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 8, batch: int = 250, rate: float = 0.1, decay: float = 2e-5) -> Field:
    """Fit the field to labelled texts by Adam on the exact conditional log-likelihood."""
    words, labels = _encode(table)
    types: dict[str, int] = {}
    rows = [[types.setdefault(w, len(types)) for w in ws] for ws in words]
    counts: dict[str, int] = {}
    feats = [word_features(w) for w in types]
    for ws in words:
        for w in ws:
            for f in feats[types[w]]:
                counts[f] = counts.get(f, 0) + 1
    index = {f: i for i, f in enumerate(f for f, n in counts.items() if n > 2)}
    nf, k, no = len(index), len(LABELS), len(OFFSETS)
    ids = [[index[f] for f in fs if f in index] for fs in feats]
    width = max(map(len, ids))
    table_ids = np.full((len(ids) + 1, width), nf)
    for i, x in enumerate(ids):
        table_ids[i, : len(x)] = x
    pad = len(ids)
    rng = np.random.default_rng(0)
    w, m, f0 = np.zeros((no, nf + 1, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, m, f0)]
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    step = 0
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            chosen = batches[b]
            n, t = len(chosen), max(len(rows[i]) for i in chosen)
            x = np.full((n, t + 2 * OFFSETS[-1]), pad)
            y, mask = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
            for r, i in enumerate(chosen):
                size = len(rows[i])
                x[r, OFFSETS[-1] : OFFSETS[-1] + size] = rows[i]
                y[r, :size], mask[r, :size] = labels[i], True
            used, inverse = np.unique(x, return_inverse=True)
            inverse = inverse.reshape(x.shape)
            type_scores = w[:, table_ids[used]].sum(2)
            emit = sum(type_scores[o][inverse[:, o : o + t]] for o in range(no))
            alpha, beta = np.empty_like(emit), np.zeros_like(emit)
            alpha[:, 0] = emit[:, 0] + f0
            for j in range(1, t):
                a = _logsum(alpha[:, j - 1, :, None] + m, 1) + emit[:, j]
                alpha[:, j] = np.where(mask[:, j, None], a, alpha[:, j - 1])
            z = _logsum(alpha[:, -1], 1)
            for j in range(t - 2, -1, -1):
                c = _logsum(m + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
                beta[:, j] = np.where(mask[:, j + 1, None], c, 0)
            prob = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            grad = -prob
            np.add.at(grad, (np.arange(n)[:, None], np.arange(t), y), mask.astype(np.float32))
            gm = np.zeros((k, k))
            for j in range(1, t):
                both = mask[:, j]
                p = np.exp(alpha[both, j - 1, :, None] + m + (emit[both, j] + beta[both, j])[:, None, :] - z[both, None, None])
                gm -= p.sum(0)
                np.add.at(gm, (y[both, j - 1], y[both, j]), 1.0)
            g0 = grad[:, 0].sum(0)
            gw = np.zeros_like(w)
            flat = grad.reshape(-1, k)
            for o in range(no):
                cells = inverse[:, o : o + t].reshape(-1)
                gt = np.stack([np.bincount(cells, flat[:, c], len(used)) for c in range(k)], 1)
                at = table_ids[used].reshape(-1)
                spread = np.repeat(gt, width, 0)
                gw[o] = np.stack([np.bincount(at, spread[:, c], nf + 1) for c in range(k)], 1)
            step += 1
            for p, g, (m1, m2) in zip((w, m, f0), (gw, gm, g0), state, strict=True):
                g = (g / n - decay * len(batches) * p).astype(np.float32)
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            w[:, nf] = 0
    return Field(index, w, m, f0)


@functools.cache
def trained(n: int = TRAINING_TEXTS) -> Field:
    return train(labelled_texts(n))


_DOT = r"(?:\s?[(\[]\s?dot\s?[)\]]\s?|\s+dot\s+)"
_EMAIL = re.compile(rf"[\w.+-]+(?:{_DOT}[\w.+-]+)*(?:@|\s?[(\[]\s?at\s?[)\]]\s?|\s+at\s+)[\w-]+(?:(?:\.|{_DOT})[\w-]+)+", re.I)


def checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The piece with its edges set right, or None if its written form can't be of the kind."""
    while start < end and text[start] in " \n.,;:!?-–—'\"“”|":
        start += 1
    while start < end and text[end - 1] in " \n,;:!?-–—'\"“”|(@#/":
        end -= 1
    value = text[start:end]
    n = sum(c.isdigit() for c in value)
    if kind == "email":
        lo = start
        while lo > 0 and (text[lo - 1].isalnum() or text[lo - 1] in "._+-"):
            lo -= 1
        hit = next((m for at in range(lo, end) if (m := _EMAIL.match(text, at))), None)
        return hit and hit.span()
    if kind == "phone":
        start += value.startswith("(") and not re.match(r"\(\+?\d{1,5}\)", value)
        value = text[start:end]
        if start and text[start] not in "+(":  # a plus, or the bracket of a prefix in brackets, but none around the whole
            start -= text[start - 1] == "+" or (text[start - 1] == "(" and bool(re.match(r"\+?\d{1,5}\)", value)))
        end -= text[start:end].endswith(")") and text.count("(", start, end) < text.count(")", start, end)
        return (start, end) if 7 <= n <= 18 else None
    if kind == "id_number":
        return (start, end) if n >= 5 else None
    if kind == "address":
        return (start, end) if n and len(value) > 5 and re.search(r"[^\W\d_]{3}", value) else None
    words = re.findall(r"[^\W\d_]+", value)
    if words and len(words[0]) == 1 and value[1:2] not in (".", "’", "'"):  # an initial has its point
        return None
    return (start, end) if len(words) >= 2 and max(map(len, words)) > 2 else None


@functools.cache
def _plain_table() -> dict[int, str]:
    """Look-alike code points and what they look like, one character or none."""
    to = Rewriter({chr(c): 1 for c in range(32, 127)}).to
    return {ord(a): b for a, b in to.items() if len(a) == 1 and len(b) < 2 and a != "\t"}


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text as it looks, and where its characters stand in the stored text (None: at the same places)."""
    if text.isascii():
        return text, None
    table = _plain_table()
    out = text.translate(table)
    return out, None if len(out) == len(text) else [i for i, c in enumerate(text) if table.get(ord(c), c)]


class Decoder:
    """Viterbi decoding of batches of texts."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(OFFSETS), len(LABELS)), np.float32)
        self.used = 1  # row 0: beyond the text

    def ids(self, words: list[str]) -> list[int]:
        rows, out = self.rows, []
        for w in words:
            i = rows.get(w)
            if i is None:
                if self.used == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                i = rows[w] = self.used
                self.table[i] = self.field.scores(w)
                self.used += 1
            out.append(i)
        return out

    def labels(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """(words, starts, labels) of each text."""
        if self.used > WORDS_KEPT:
            self.reset()
        cut = [pieces(t) for t in texts]
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(cut[i][0]))
        reach, at = OFFSETS[-1], 0
        while at < len(order):
            chosen, size = [], 0
            while at < len(order) and (not chosen or (len(chosen) + 1) * len(cut[order[at]][0]) <= 60_000):
                chosen.append(order[at])
                at += 1
            size = len(cut[chosen[-1]][0])
            if not size:
                for i in chosen:
                    out[i] = (*cut[i], np.zeros(0, np.int8))
                continue
            x = np.zeros((size + 2 * reach, len(chosen)), np.int64)
            lengths = np.array([len(cut[i][0]) for i in chosen])
            for c, i in enumerate(chosen):
                x[reach : reach + lengths[c], c] = self.ids(cut[i][0])
            emit = self.table[x[:size], 0]
            for o in range(1, len(OFFSETS)):
                emit += self.table[x[o : o + size], o]
            back = np.zeros(emit.shape, np.int8)
            score, moves = emit[0] + self.field.first, self.field.moves
            best = np.zeros((len(chosen), len(LABELS)), np.float32)
            for t in range(1, size):
                np.copyto(best, score[:, :1] + moves[0])
                arg = back[t]
                for k in range(1, len(LABELS)):
                    s = score[:, k : k + 1] + moves[k]
                    better = s > best
                    np.copyto(best, s, where=better)
                    np.copyto(arg, k, where=better)
                new = best + emit[t]
                live = t < lengths
                score = np.where(live[:, None], new, score)
            state = score.argmax(1)
            path = np.zeros((size, len(chosen)), np.int8)
            for t in range(size - 1, -1, -1):
                path[t] = state
                live = t < lengths
                state = np.where(live, back[t][np.arange(len(chosen)), state], state) if t else state
            for c, i in enumerate(chosen):
                out[i] = (*cut[i], path[: lengths[c], c])
        return out

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the pieces of personal data of each text, read as it looks."""
        looks = [plain(t) for t in texts]
        found = self.find_plain([t for t, _ in looks])
        return [spans if at is None else [(at[a], at[b - 1] + 1, k) for a, b, k in spans] for spans, (_, at) in zip(found, looks, strict=True)]

    def find_plain(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the pieces of personal data of each text."""
        found = []
        for text, (words, starts, labels) in zip(texts, self.labels(texts), strict=True):
            spans: list[tuple[int, int, str]] = []
            hits = np.flatnonzero(labels)
            j = 0
            while j < len(hits):
                i = k = hits[j]
                kind = (labels[i] - 1) // 2
                while j + 1 < len(hits) and hits[j + 1] == k + 1 and labels[k + 1] == 2 * kind + 2:
                    j += 1
                    k = hits[j]
                j += 1
                edge = checked(text, int(starts[i]), int(starts[k]) + len(words[k].partition(_TIE)[0]), KINDS[kind])
                if edge and (not spans or edge[0] >= spans[-1][1]):
                    spans.append((*edge, KINDS[kind]))
            found.append(spans)
        return found


def personal_pieces(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, kind, start_pos, end_pos: one row for each piece of personal data in the column."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", kind string, start_pos long, end_pos long"
    field = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(field)
        for b in batches:
            rows = [(n, kind, s, e) for n, spans in enumerate(decoder.find(list(b[text]))) for s, e, kind in spans]
            if not rows:
                continue
            got = b[keys].iloc[[r[0] for r in rows]].reset_index(drop=True)
            got["kind"], got["start_pos"], got["end_pos"] = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
            yield got

    return widened(df.select(*keys, text).filter(F.length(text) > 0)).mapInPandas(run, schema)


def without_personal(df: DataFrame, text: str, out: str = "masked") -> DataFrame:
    """Add ``out``: the text with a typed placeholder such as ``[PHONE]`` in place of each piece, all else unchanged."""
    schema = out_schema(df, **{out: "string"})
    field = trained()

    def mask(t: str | None, spans: list[tuple[int, int, str]]) -> str | None:
        if not spans:
            return t
        parts, at = [], 0
        for s, e, kind in spans:
            parts += [t[at:s], f"[{kind.upper()}]"]
            at = e
        return "".join([*parts, t[at:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(field)
        for b in batches:
            texts = list(b[text])
            b[out] = [mask(t, s) for t, s in zip(texts, decoder.find([t or "" for t in texts]), strict=True)]
            yield b

    return widened(df).mapInPandas(run, schema)
