"""Languages of documents and of their stretches, by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text from both sides, BLOCK bytes a step, and labels every position with a
probability for each language. It is trained in numpy by backpropagation through time on a bounded sample of
labelled documents (PER_LANGUAGE of each language, whatever the size of the table). Probabilities are pooled over
sentences and documents. Texts are cut into windows with CONTEXT steps of warm-up on both sides, so
long and short texts share batches; whole texts are read.

Defined results: null, empty and letterless texts have no language and give no row; labels are compared by the
language they name, in any notation; a stretch is a sentence of at least MIN_WORDS words, so quoted
words, code and tags are none; ties go to the language first in CODES; repeated documents are judged apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.llm.pairs import SMALL_WORDS
from siltline.session import widened

CODES = ["en", "de", "fr", "es", "pt", "it", "nl"]
PER_LANGUAGE = 300  # labelled documents of each language in the training sample
SAMPLE_CHARS = 4000  # characters that the sample takes of each of its documents; documents are judged whole
BLOCK, HIDDEN = 4, 32  # bytes a step; units of each direction
WINDOW, CONTEXT = 128, 16  # steps labelled together, steps of warm-up on each side
MIN_WORDS, MIN_CONFIDENCE = 2, 0.9  # of a stretch in another language than the document's; a single word is a quotation
# Other notations of the languages.
NOTATIONS = {
    "en": "en eng english englisch anglais inglés ingles inglese engels", "de": "de ger deu german deutsch allemand alemán aleman alemão tedesco duits", "fr": "fr fre fra french französisch français francais francés francese frans",
    "es": "es spa spanish spanisch espagnol español espanol castellano spagnolo spaans esp", "pt": "pt por portuguese portugiesisch portugais portugués português portugues portoghese portugees", "it": "it ita italian italienisch italien italiano italiaans", "nl": "nl dut nld dutch niederländisch néerlandais neerlandés holandês olandese nederlands hollands",
}
_SMALL = {k: frozenset(v.split()) for k, v in SMALL_WORDS.items()}


def label_code(c: Column) -> Column:
    """The code of the language that a label names; null if it names none of CODES."""
    low = F.lower(F.trim(c))
    names = F.create_map(*[F.lit(x) for k, v in NOTATIONS.items() for n in v.split() for x in (n, k)])
    return F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.regexp_extract(low, r"^(\p{L}{2,3})(?:[-_][\p{L}\p{N}]+)*(?:\.[\w-]+)?$", 1)))


def _cell(h: np.ndarray, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    n = HIDDEN
    hu = h @ u
    z = 0.5 * np.tanh(0.5 * (x[:, :n] + hu[:, :n])) + 0.5
    r = 0.5 * np.tanh(0.5 * (x[:, n : 2 * n] + hu[:, n : 2 * n])) + 0.5
    c = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
    return c + z * (h - c), z, r, c, hu[:, 2 * n :]


class Network:
    """Byte tables (input weights), recurrent weights of both directions and the output layer."""

    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "tf": f(BLOCK, 256, 3 * HIDDEN, scale=0.15), "tb": f(BLOCK, 256, 3 * HIDDEN, scale=0.15), "uf": f(HIDDEN, 3 * HIDDEN, scale=0.18), "ub": f(HIDDEN, 3 * HIDDEN, scale=0.18),
            "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32), "of": f(HIDDEN, len(CODES), scale=0.2), "ob": f(HIDDEN, len(CODES), scale=0.2), "o": np.zeros(len(CODES), np.float32),
        }

    def inputs(self, blocks: np.ndarray, side: str) -> np.ndarray:
        table = self.p["t" + side]
        x = table[0][blocks[..., 0]] + self.p["b" + side]
        for k in range(1, BLOCK):
            x += table[k][blocks[..., k]]
        return x

    def states(self, blocks: np.ndarray, live: np.ndarray, side: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (steps, batch, unit) of one direction; ``live`` marks steps within the text."""
        x, u, steps = self.inputs(blocks, side), self.p["u" + side], len(blocks)
        h = np.zeros((blocks.shape[1], HIDDEN), np.float32)
        out, cache = np.empty((steps, blocks.shape[1], HIDDEN), np.float32), [None] * steps
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            new, z, r, c, hc = _cell(h, x[t], u)
            new *= live[t][:, None]
            if keep:
                cache[t] = (h, z, r, c, hc)
            h = out[t] = new
        return out, cache

    def probabilities(self, blocks: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities (steps, batch, language) of every position.

        The same recurrence as ``states``, step by step in small buffers: gates are written as tanh of half their input, the
        halves are folded into the weights, and no array over all steps but the states is kept.
        """
        steps, batch = blocks.shape[:2]
        n, size = HIDDEN, len(CODES)
        score = np.empty((steps, batch, size), np.float32)
        half = np.concatenate([np.full(2 * n, 0.5), np.ones(n)]).astype(np.float32)
        x, y, hu = (np.empty((batch, 3 * n), np.float32) for _ in range(3))
        c, d = (np.empty((batch, n), np.float32) for _ in range(2))
        columns = np.ascontiguousarray(blocks.transpose(0, 2, 1)).astype(np.intp)
        whole = live.all(1)
        for side in "fb":
            tables = self.p["t" + side].astype(np.float32) * half
            tables[0] += self.p["b" + side] * half
            u, o = self.p["u" + side] * np.float32(0.5), self.p["o" + side]
            h = np.zeros((batch, n), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                np.take(tables[0], columns[t, 0], axis=0, out=x, mode="clip")
                for k in range(1, BLOCK):
                    np.take(tables[k], columns[t, k], axis=0, out=y, mode="clip")
                    x += y
                np.dot(h, u, out=hu)
                gates = x[:, : 2 * n]
                gates += hu[:, : 2 * n]
                np.tanh(gates, out=gates)
                candidate, part = x[:, 2 * n :], hu[:, 2 * n :]
                np.multiply(gates[:, n:], part, out=d)  # half of r times the state's part, without its constant
                candidate += part
                candidate += d
                np.tanh(candidate, out=c)
                np.subtract(h, c, out=d)
                d *= gates[:, :n]
                h += c
                h += d
                h *= 0.5
                if not whole[t]:
                    h *= live[t][:, None]
                if side == "f":
                    np.dot(h, o, out=score[t])
                else:
                    score[t] += h @ o
        score += self.p["o"]
        score -= score.max(-1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(-1, keepdims=True)
        return score

    def gradient(self, blocks: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of every position and its gradient, by backpropagation through time."""
        hf, cf = self.states(blocks, live, "f", True)
        hb, cb = self.states(blocks, live, "b", True)
        s = hf @ self.p["of"] + hb @ self.p["ob"] + self.p["o"]
        s = np.exp(s - s.max(-1, keepdims=True))
        prob = s / s.sum(-1, keepdims=True)
        weight = live / live.sum()
        t_, b_ = np.indices(y.shape)
        loss = float(-(np.log(prob[t_, b_, y] + 1e-9) * weight).sum())
        d = prob.copy()
        d[t_, b_, y] -= 1
        d *= weight[..., None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = d.sum((0, 1))
        for side, h, cache in (("f", hf, cf), ("b", hb, cb)):
            g["o" + side] = np.einsum("tbh,tbk->hk", h, d)
            back = d @ self.p["o" + side].T
            u, n, steps = self.p["u" + side], HIDDEN, len(blocks)
            dx = np.zeros((*blocks.shape[:2], 3 * n), np.float32)
            dh = np.zeros_like(h[0])
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                prev, z, r, c, hc = cache[t]
                total = (back[t] + dh) * live[t][:, None]
                dz = total * (prev - c) * z * (1 - z)
                dc = total * (1 - z) * (1 - c * c)
                dr = dc * hc * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                g["u" + side] += prev.T @ du
                dh = total * z + du @ u.T
            g["b" + side] = dx.sum((0, 1))
            flat = dx.reshape(-1, 3 * n)
            for k in range(BLOCK):  # the rows of each byte, put together and summed
                byte = blocks[..., k].reshape(-1)
                order = np.argsort(byte, kind="stable")
                used, starts = np.unique(byte[order], return_index=True)
                g["t" + side][k][used] = np.add.reduceat(flat[order], starts, axis=0)
        return loss, g


def _bytes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    pad = -len(raw) % BLOCK
    return np.concatenate([raw, np.full(pad, 32, np.uint8)]).reshape(-1, BLOCK) if pad else raw.reshape(-1, BLOCK)


def train(sample: list[tuple[str, str]], steps: int = 360, batch: int = 112, length: int = 32, rate: float = 0.012, seed: int = 0) -> Network:
    """Fit the network to (text, code) pairs by Adam."""
    rng, net = np.random.default_rng(seed), Network(seed)
    by = {c: [_bytes(t.lower()) for t, k in sample if k == c and len(t) > 24] for c in CODES}
    by = {c: v for c, v in by.items() if v}
    if not by:
        return net
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    names = list(by)
    for step in range(1, steps + 1):
        blocks, live = np.full((length, batch, BLOCK), 32, np.uint8), np.zeros((length, batch), np.float32)
        y = np.zeros((length, batch), np.int64)
        for b in range(batch):
            # half of the sequences are of one language, the others change it again and again after a few steps
            ends = [length] if b % 2 == 0 else [min(length, int(e)) for e in np.cumsum(rng.integers(3, 15, length // 3))]
            ends = ends[: ends.index(length) + 1]
            parts = [(names[(b // 2) % len(names)] if len(ends) == 1 else names[rng.integers(len(names))], e) for e in ends]
            at = 0
            for code, end in parts:
                raw = by[code][rng.integers(len(by[code]))]
                start = rng.integers(max(1, len(raw) - length // 2))
                part = raw[start : start + end - at]
                blocks[at : at + len(part), b], live[at : at + len(part), b], y[at : at + len(part), b] = part, 1, CODES.index(code)
                at += len(part)
        _, g = net.gradient(blocks, live, y)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, p in net.p.items():
            m, v = state[k]
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] * g[k] - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def label_positions(net: Network, texts: list[str], batch: int = 384) -> list[np.ndarray]:
    """Probabilities (blocks, languages) of every position of each text."""
    raws = [_bytes(t.lower()) for t in texts]
    windows = [(i, a) for i, r in enumerate(raws) for a in range(0, len(r), WINDOW)]
    size = lambda w: min(len(raws[w[0]]), w[1] + WINDOW + CONTEXT) - max(0, w[1] - CONTEXT)
    windows.sort(key=size)
    out = [np.empty((len(r), len(CODES)), np.float32) for r in raws]
    for at in range(0, len(windows), batch):
        group = windows[at : at + batch]
        steps = size(group[-1])
        blocks, live = np.full((steps, len(group), BLOCK), 32, np.uint8), np.zeros((steps, len(group)), np.float32)
        for b, w in enumerate(group):
            a, n = max(0, w[1] - CONTEXT), size(w)
            blocks[:n, b], live[:n, b] = raws[w[0]][a : a + n], 1
        prob = net.probabilities(blocks, live)
        for b, (i, a) in enumerate(group):
            skip, end = a - max(0, a - CONTEXT), min(len(raws[i]), a + WINDOW)
            out[i][a:end] = prob[skip : skip + end - a, b]
    return out


_CUT = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\n+")
_CODE = re.compile(r"[{}<>=_|\\]|;\s*$|\w\(|\)\.|^\s*[@#/$]|https?:|^[A-Z][A-Z]+ |\w\.\w+\(")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text, in characters."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def stretches(text: str, prob: np.ndarray) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, code, confidence, counts) of each sentence; ``counts`` if it is a sentence of language."""
    out, byte, at = [], 0, 0
    logs = np.log(prob + 1e-6)
    for a, b in sentences(text):
        byte += len(text[at:a].lower().encode("utf-8", "replace"))
        size = len(text[a:b].lower().encode("utf-8", "replace"))
        lo, hi = byte // BLOCK, max(byte // BLOCK + 1, (byte + size) // BLOCK)
        byte, at = byte + size, b
        part = logs[lo:hi].mean(0) if hi > lo and lo < len(logs) else logs.mean(0)
        p = np.exp((part - part.max()) * 4)
        p /= p.sum()
        words = _WORDS.findall(text[a:b])
        k = int(p.argmax())
        whole = len(words) >= MIN_WORDS and not _CODE.search(text[a:b]) and sum(map(len, words)) > 0.6 * (b - a)
        out.append((a, b, CODES[k], float(p[k]), whole))
    return out


def judge(text: str, prob: np.ndarray) -> tuple[str, float, dict[str, float], list[tuple[int, int, str, float, bool]]] | None:
    """(main language, confidence, further languages with their confidence, stretches) of a text."""
    if not _WORDS.search(text):
        return None
    parts = stretches(text, prob)
    mass = dict.fromkeys(CODES, 0.0)
    for a, b, code, c, whole in parts:
        mass[code] += (b - a) * c * (1.0 if whole else 0.05)
    main = max(CODES, key=lambda k: mass[k])
    more: dict[str, float] = {}
    for a, b, code, c, whole in parts:
        if whole and code != main and c >= MIN_CONFIDENCE:
            more[code] = max(more.get(code, 0.0), c)
    return main, mass[main] / (sum(mass.values()) or 1.0), more, parts


def training_sample(documents: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, the first SAMPLE_CHARS characters of each, drawn by a hash of the id."""
    d = documents.select("doc_id", "text", label_code(F.col("lang")).alias("code")).filter(F.col("code").isNotNull() & (F.length("text") > 40))
    counts = {r.code: r["count"] for r in d.groupBy("code").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.create_map(*[F.lit(x) for c in CODES for x in (c, min(1.0, 2.0 * per_language / max(1, counts.get(c, 0))))])
    # the lowest draws first, so that the sample doesn't depend on how the table is partitioned
    drawn = d.withColumn("draw", draw).filter(F.col("draw") < F.element_at(share, F.col("code"))).select("draw", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "code")
    drawn = drawn.orderBy("draw", "doc_id", "text").limit(per_language * len(CODES) * 4)
    kept: dict[str, list[str]] = {c: [] for c in CODES}
    for r in drawn.collect():
        words = [w.lower() for w in _WORDS.findall(r.text)]
        votes = {k: sum(w in s for w in words) for k, s in _SMALL.items()}
        if votes[r.code] == max(votes.values()) and len(kept[r.code]) < per_language:  # a label that the text's small words belie is left out
            kept[r.code].append(r.text)
    return [(t, c) for c, texts in kept.items() for t in texts]


_networks: dict[str, Network] = {}


def trained(documents: DataFrame) -> Network:
    """The network of a table's sample; one that the process has trained on the same sample is used again."""
    sample = training_sample(documents)
    key = hashlib.sha256(repr(sample).encode("utf-8", "replace")).hexdigest()
    if key not in _networks:
        _networks.clear()
        _networks[key] = train(sample)
    return _networks[key]


def document_languages(documents: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, label_code, main, confidence, more (code, confidence), stretches (start, end, code, confidence) of each document with letters."""
    net = trained(documents) if net is None else net
    d = documents.select("doc_id", "text", label_code(F.col("lang")).alias("label_code")).filter(F.length("text") > 0)
    shared = documents.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Network()
        own.p = shared.value
        for b in batches:
            for lo in range(0, len(b), 1500):
                c = b.iloc[lo : lo + 1500]
                texts = list(c["text"])
                rows = []
                for i, (t, p) in enumerate(zip(texts, label_positions(own, texts), strict=True)):
                    if (j := judge(t, p)) is not None:
                        rows.append((i, j[0], j[1], [{"code": k, "confidence": v} for k, v in j[2].items()], [{"start_pos": a, "end_pos": e, "code": k, "confidence": v} for a, e, k, v, whole in j[3] if whole]))
                if not rows:
                    continue
                got = pd.DataFrame(rows, columns=["i", "main", "confidence", "more", "stretches"])
                at = got.pop("i").to_numpy(np.int64)
                got.insert(0, "label_code", c["label_code"].to_numpy()[at])
                got.insert(0, "doc_id", c["doc_id"].to_numpy()[at])
                yield got

    schema = "doc_id long, label_code string, main string, confidence double, more array<struct<code:string,confidence:double>>, stretches array<struct<start_pos:long,end_pos:long,code:string,confidence:double>>"
    return widened(d).mapInPandas(run, schema)


def language_cases(documents: DataFrame) -> DataFrame:
    """doc_id, scope, lang_code: documents whose label is missing or wrong, and further languages of mixed documents."""
    d = document_languages(documents)
    cases = F.concat(
        F.when(F.col("label_code").isNull() | (F.col("label_code") != F.col("main")), F.array(F.struct(F.lit("doc").alias("scope"), F.col("main").alias("lang_code")))).otherwise(F.array().cast("array<struct<scope:string,lang_code:string>>")),
        F.transform("more", lambda m: F.struct(F.lit("mix").alias("scope"), m["code"].alias("lang_code"))),
    )
    return d.select("doc_id", F.explode(cases).alias("c")).select("doc_id", "c.scope", "c.lang_code")
