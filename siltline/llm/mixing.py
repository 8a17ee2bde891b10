"""Sources mixed to target shares of the total size.

Tokens are summed per source (a partial aggregation, so a source of any size is no hot key), each source of a
mix gets a rate = wanted tokens / its tokens, at most ``max_repeats``, and each document comes out floor(rate)
times plus once more with the probability of the fraction, drawn from a seeded hash of its id. What a
source at its cap cannot give is spread over the other sources in proportion to their shares.

Defined results: the total of a mix is by default the tokens that its sources hold; documents of null or
unlisted sources and texts without tokens are used in no mix; a listed source without documents has the rate 0 and
the actual share 0; repeated target rows of one source add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.tokens import TOKENIZER, with_tokens
from siltline.session import checkpointed

MAX_TARGETS = 100_000  # rows of the target table


def rates_of(targets: dict[str, tuple[float, int]], held: dict[str, int], total: float | None = None) -> dict[str, float]:
    """How often each source is used: ``targets`` has share and cap, ``held`` the tokens of each source."""
    total = float(sum(held.get(s, 0) for s in targets)) if total is None else total
    rates: dict[str, float] = {}
    open_ = {s for s in targets if held.get(s, 0) > 0 and targets[s][0] > 0}
    left = total
    while open_:
        share = sum(targets[s][0] for s in open_)
        wanted = {s: left * targets[s][0] / share / held[s] for s in open_}
        capped = {s for s in open_ if wanted[s] > targets[s][1]}
        if not capped:
            rates |= wanted
            break
        for s in capped:
            rates[s] = float(targets[s][1])
            left -= rates[s] * held[s]
        open_ -= capped
        if left <= 0:
            break
    return {s: rates.get(s, 0.0) for s in targets}


def mix_rates(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """mix_name, source, target_share, max_repeats, tokens_held, rate."""
    spark = sized.sparkSession
    targets = targets.filter("mix_name is not null and source is not null").groupBy("mix_name", "source")
    targets = targets.agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = sized.filter("source is not null").groupBy("source").agg(F.sum("tokens").alias("held"))
    rows = targets.join(held, "source", "left").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    mixes: dict[str, dict] = {}
    for r in rows:
        mixes.setdefault(r.mix_name, {})[r.source] = (float(r.target_share or 0), int(r.max_repeats or 0), int(r.held or 0))
    out = []
    for mix, t in sorted(mixes.items()):
        rates = rates_of({s: v[:2] for s, v in t.items()}, {s: v[2] for s, v in t.items()}, total)
        out += [(mix, s, *t[s], rates[s]) for s in sorted(t)]
    return spark.createDataFrame(out, "mix_name string, source string, target_share double, max_repeats int, tokens_held long, rate double")


def mix_documents(documents: DataFrame, targets: DataFrame, seed: int = 42, total: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): mix_name, doc_id, source, tokens, uses; and what each source of each mix really reaches."""
    sized = checkpointed(with_tokens(documents, "text", ["doc_id", "source"], tokenizer))
    rates = mix_rates(sized, targets, total)
    each = sized.filter("tokens > 0").join(F.broadcast(rates.filter("rate > 0")), "source")
    draw = F.pmod(F.xxhash64("mix_name", "doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor("rate")
    uses = whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)
    used = each.withColumn("uses", uses.cast("int")).filter("uses > 0").select("mix_name", "doc_id", "source", "tokens", "uses")
    got = used.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.sum(F.col("uses").cast("long")).alias("documents_used"))
    shares = rates.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens_used", "documents_used"])
    sums = shares.groupBy("mix_name").agg(F.sum("tokens_used").alias("mix_tokens"))
    shares = shares.join(sums, "mix_name").withColumn("actual_share", F.coalesce(F.round(F.try_divide("tokens_used", "mix_tokens"), 6), F.lit(0.0)))
    return used, shares.drop("mix_tokens")
