"""Mixing sources to target weights (problem 9): temperature mixing realised as budgeted block permutations.

Sizes are tokens of the public tokenizer. Weights lie on the path from the sources' token shares q (exponent 0) to the
targets t (exponent 1), w ~ q * (t / q) ** a: the shares' ratio to the targets is the base that is exponentiated. For a
given budget the largest exponent is bisected at which no source needs more than its max_repeats passes (query p9_budget_mix:
three quarters of all tokens, which small sources can't keep up with at their targets). Without a budget, it is the
largest at which the exponent 1, that is the targets themselves, keeps that limit, so every source reaches its target
share. A target entropy may be given instead; it is met by bisecting the same exponent, and the budget is then the
largest within the limit.

A source's budget is cut into whole passes and a rest. The rest is taken from a seeded permutation of hash blocks:
blocks in their order as long as they fit, then documents of the block at the edge, by running sums within that block
only; the document at the edge is in if at least half of it fits. So no task ever orders a whole source, and every
source is off its budget by half a document at most.

Defined results: a source without a target is not mixed; a target without documents, or with only empty ones, can't be
met: it is reported with share 0 and the other targets are scaled to sum to 1. Null, negative and zero targets count as
0, a null max_repeats as 1. Null sources, and texts that are null or empty (no tokens), are not mixed. Repeated doc_id
rows are separate rows. Equal hashes are ordered by doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmetry.llm import tokenizer
from quillmetry.runtime import broadcast_if_small, written

#: Blocks per source: a block of a source of N documents has about N / BLOCKS of them.
BLOCKS = 4096
#: Sources of a mix: their plan is made on the driver. More are an error.
MOST_SOURCES = 100_000


def sizes(documents: DataFrame, text: str = "text", path: str = tokenizer.RANKS) -> DataFrame:
    """doc_id, source, n_tokens of the documents that have a source and tokens, written once."""
    counted = tokenizer.encode(documents.select("doc_id", "source", text), text, "ids", path).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"))
    # the filter on the count comes after the table is written: pushed down, it would encode every text twice
    return written(counted.filter("source is not null"), "sizes").filter("n_tokens > 0")


def exponent_weights(shares: dict[str, float], targets: dict[str, float], a: float) -> dict[str, float]:
    raw = {s: shares[s] * (targets[s] / shares[s]) ** a for s in targets}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()}


def bisect_exponent(fits, steps: int = 60) -> float:
    """The largest exponent in 0..1 that fits, for a condition that only gets harder with it."""
    if fits(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def plan_weights(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None, target_entropy: float | None = None) -> tuple[dict[str, float], int, float]:
    """Weights per source, budget in tokens and exponent. The dicts have a row per source of the mix: a small dimension."""
    usable = {s: (t, r) for s, (t, r) in targets.items() if t > 0 and tokens.get(s, 0) > 0}
    if not usable:
        return {}, 0, 1.0
    scale = sum(t for t, _ in usable.values())
    goal = {s: t / scale for s, (t, _) in usable.items()}
    cap = {s: tokens[s] * r for s, (_, r) in usable.items()}
    total = sum(tokens[s] for s in usable)
    share = {s: tokens[s] / total for s in usable}
    if target_entropy is not None:
        rising = entropy(goal) < entropy(share)
        a = bisect_exponent(lambda x: (entropy(exponent_weights(share, goal, x)) >= target_entropy) == rising or entropy(exponent_weights(share, goal, x)) == target_entropy)
        weights = exponent_weights(share, goal, a)
        return weights, budget or int(min(cap[s] / w for s, w in weights.items()) + 1e-6), a
    if budget is None:
        budget = int(min(cap[s] / goal[s] for s in goal) + 1e-6)
    fits = lambda x: all(budget * w <= cap[s] * (1 + 1e-9) for s, w in exponent_weights(share, goal, x).items())
    a = bisect_exponent(fits)
    return exponent_weights(share, goal, a), budget, a


def mix(docs: DataFrame, weights: dict[str, float], budget: int, tokens: dict[str, int], caps: dict[str, int], seed: int = 42) -> DataFrame:
    """docs: doc_id, source, n_tokens. Adds copies, the times each document is used, at least 1 in the result."""
    spark = docs.sparkSession
    rows = []
    for s, w in sorted(weights.items()):
        want = min(round(budget * w), tokens[s] * caps[s])
        rows.append((s, want // tokens[s], want % tokens[s]))
    plan = broadcast_if_small(spark.createDataFrame(rows, "source string, passes bigint, rest bigint"), len(rows))
    key = F.xxhash64(F.lit(seed), "doc_id")
    own = docs.join(plan, "source").withColumns({"key": key, "block": F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(BLOCKS))})
    order = F.xxhash64(F.lit(seed + 2), "source", "block")
    before = Window.partitionBy("source").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("block_rest")).withColumn("place", order)
    blocks = blocks.withColumn("left", F.col("block_rest") - F.coalesce(F.sum("size").over(before), F.lit(0))).filter("left > 0")
    blocks = blocks.select("source", "block", "left", (F.col("left") >= F.col("size")).alias("whole"))
    placed = own.join(blocks, ["source", "block"], "left")
    upto = Window.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.filter("whole = false").withColumn("extra", (F.sum("n_tokens").over(upto) - F.col("n_tokens") / 2 <= F.col("left")).cast("long"))
    rest = placed.filter("whole is null or whole").withColumn("extra", F.coalesce(F.col("whole").cast("long"), F.lit(0).cast("long")))
    out = edge.unionByName(rest).withColumn("copies", F.col("passes") + F.col("extra"))
    return out.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def _dimension(sized: DataFrame, targets: DataFrame) -> tuple[dict[str, int], dict[str, tuple[float, int]]]:
    """Tokens by source and targets; only the sources that have a target, whose table is a small dimension."""
    goal = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("t"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("r")).filter("source is not null").dropDuplicates(["source"])
    held = goal.limit(MOST_SOURCES + 1).collect()
    if len(held) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the mix")
    by = sized.join(goal.select("source"), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    return {r.source: r.n for r in by.collect()}, {r.source: (r.t, r.r) for r in held}


def planned(documents: DataFrame, targets: DataFrame, budget: int | float | None, target_entropy: float | None, path: str) -> tuple:
    """Sizes, tokens and targets by source, weights, budget and exponent. A fractional budget is a share of all tokens of the mix's sources."""
    sized = sizes(documents, path=path)
    tokens, goal = _dimension(sized, targets)
    if isinstance(budget, float):
        budget = round(budget * sum(n for s, n in tokens.items() if goal[s][0] > 0))
    return sized, tokens, goal, *plan_weights(tokens, goal, budget, target_entropy)


def mixed(documents: DataFrame, targets: DataFrame, budget: int | float | None = None, target_entropy: float | None = None, seed: int = 42, path: str = tokenizer.RANKS) -> DataFrame:
    """doc_id, source, n_tokens, copies of every document used in the mix."""
    sized, tokens, goal, weights, total, _ = planned(documents, targets, budget, target_entropy, path)
    return mix(sized, weights, total, tokens, {s: r for s, (_, r) in goal.items()}, seed)


def weights_report(documents: DataFrame, targets: DataFrame, budget: int | float | None = 0.75, path: str = tokenizer.RANKS) -> DataFrame:
    """Weights by source of three plans: the targets, the budget, and the entropy half-way between token shares and targets.

    plan, source, tokens, token_share, target_share, weight, exponent (bisected), budget in tokens, passes over the source.
    """
    sized, tokens, goal, *_ = planned(documents, targets, None, None, path)
    whole = sum(n for s, n in tokens.items() if goal[s][0] > 0)
    weigh = lambda b, e: plan_weights(tokens, goal, b, e)
    plans = {"targets": weigh(None, None), "budget": weigh(round(budget * whole) if isinstance(budget, float) else budget, None)}
    share, full = exponent_weights, plans["targets"][0]
    if full:
        own = {s: tokens[s] / whole for s in full}
        plans["entropy"] = weigh(None, (entropy(share(own, full, 0.0)) + entropy(share(own, full, 1.0))) / 2)
    rows = [(name, s, tokens[s], tokens[s] / whole, float(goal[s][0]), w, a, total, total * w / tokens[s]) for name, (weights, total, a) in plans.items() for s, w in sorted(weights.items())]
    return sized.sparkSession.createDataFrame(rows, "plan string, source string, tokens bigint, token_share double, target_share double, weight double, exponent double, budget bigint, passes double")


def report(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source's target, documents, tokens, mean and largest number of copies, and its actual share of the mix."""
    by = used.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per target: a small dimension
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("source", "target_share", "max_repeats", zero("documents"), zero("tokens"), zero("most_copies"), F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)).alias("actual_share"))
