"""Texts into containers of fixed capacity, by harmonic packing.

A text of size s belongs to class k = capacity // s: exactly k texts of its class fit into one container. Each
class fills its containers with k texts; what then stays free is topped up with the largest text that
still fits, taken from the higher classes. Workers pack independent groups of documents (a salt of the
document id), so no group grows with the data; each group leaves at most one ill-filled container per class.

Defined results: a text above the capacity is cut into full containers and a rest that is packed like any other
text; texts without tokens (null or empty) are put into the first container of their group; equal sizes are taken in the
order of their ids; a repeated id is packed as often as it stands in the table; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.tokens import TOKENIZER, with_tokens

GROUP_ROWS = 40_000  # documents that one worker packs together, on average


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (all between 1 and the capacity)."""
    order = np.argsort(-sizes, kind="stable")
    by_size: dict[int, list[int]] = {}
    for i in order[::-1]:
        by_size.setdefault(int(sizes[i]), []).append(int(i))  # the last one is taken first
    present = sorted(by_size)
    below = list(range(-1, len(present)))  # below[j + 1]: greatest index <= j whose size is still present

    def find(j: int) -> int:
        root = j + 1
        while below[root] != root - 1:
            root = below[root] + 1
        while below[j + 1] != root - 1:
            below[j + 1], j = root - 1, below[j + 1]
        return root - 1

    below[0] = -1
    out = np.full(len(sizes), -1, np.int64)
    def take(limit: int) -> int | None:
        j = find(bisect.bisect_right(present, limit) - 1)
        if j < 0:
            return None
        s = present[j]
        i = by_size[s].pop()
        if not by_size[s]:
            below[j + 1] = j - 1
        return i

    bin_no = 0
    for i in order:
        if out[i] >= 0:
            continue
        size = int(sizes[i])
        k, floor_ = capacity // size, capacity // (capacity // size + 1)  # class k: sizes in (capacity/(k+1), capacity/k]
        free, count = capacity, 0
        while count < k:
            j = find(bisect.bisect_right(present, min(free, capacity // k)) - 1)
            if j < 0 or present[j] <= floor_:
                break
            x = take(present[j])
            out[x] = bin_no
            free -= int(sizes[x])
            count += 1
        while free > 0 and (x := take(free)) is not None:
            out[x] = bin_no
            free -= int(sizes[x])
        bin_no += 1
    return out


def pack_group(ids: np.ndarray, tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, size, container) of all pieces of a group."""
    order = np.lexsort((ids, -tokens))
    full = tokens[order] // capacity * (tokens[order] > capacity)
    rest = tokens[order] - full * capacity
    rows = np.repeat(order, full + (rest > 0))
    piece = np.concatenate([np.arange(n) for n in full + (rest > 0)]) if len(order) else np.zeros(0, np.int64)
    sizes = np.minimum(capacity, tokens[rows] - piece * capacity)
    small = sizes < capacity
    bins = np.empty(len(rows), np.int64)
    bins[~small] = np.arange((~small).sum())
    if small.any():
        bins[small] = pack(sizes[small], capacity) + (~small).sum()
    none = np.flatnonzero(tokens == 0)
    return (np.r_[rows, none], np.r_[piece, np.zeros(len(none), np.int64)], np.r_[sizes, np.zeros(len(none), np.int64)], np.r_[bins, np.zeros(len(none), np.int64)])


def pack_documents(documents: DataFrame, packs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """pack_name, container, doc_id, piece, tokens: the place of every piece of every text in every pack."""
    groups = max(1, documents.count() // GROUP_ROWS)
    sized = with_tokens(documents, text, [key], tokenizer).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(groups)))
    packs = packs.select("pack_name", F.col("capacity_tokens").alias("capacity")).filter("capacity > 0").distinct()
    each = sized.crossJoin(F.broadcast(packs))  # a fixed handful of packs

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, piece, size, bins = pack_group(g[key].to_numpy(), g["tokens"].to_numpy(np.int64), int(g["capacity"].iloc[0]))
        salt = int(g["salt"].iloc[0])
        return pd.DataFrame({"pack_name": g["pack_name"].iloc[0], "container": (np.int64(salt) << np.int64(32)) + bins, key: g[key].to_numpy()[rows], "piece": piece.astype(np.int32), "tokens": size})

    kind = documents.schema[key].dataType.simpleString()
    return each.groupBy("pack_name", "salt").applyInPandas(run, f"pack_name string, container long, `{key}` {kind}, piece int, tokens long")


def pack_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, capacity_tokens, n_containers, n_pieces, tokens, fill: how full the containers are."""
    bins = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    out = bins.groupBy("pack_name").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("tokens"))
    out = out.join(F.broadcast(packs.select("pack_name", "capacity_tokens")), "pack_name")
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 4))
