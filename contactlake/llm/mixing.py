"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets a weight in proportion to p ** a. The exponent
is the largest one in [0, 1] whose weights reach the target entropy, unless that would repeat
a source more often than allowed; then it is the smallest one that keeps to the limit. It is
found by bisection, six halvings at a time: one aggregate evaluates the 63 inner points that
six halvings could visit, for any number of sources, and the driver sees these points alone.

A source's budget, its weight times the token budget, is then filled from a permutation of
its documents. Each document gets a block by a seeded hash; block order is the permutation,
and within a block the hash decides. Documents longer than a block or an eighth of their source
come behind the others, by doublings of length, so that one cannot use up the budget of shorter
ones. Whole passes over the source come first, then the
prefix of the permutation that still fits. Running sums are taken over groups of blocks, over
blocks and inside a block, so that no task holds a source.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm.common import WORD, match, save

TARGET_ENTROPY = 0.95
MAX_PASSES = 4.0
BLOCK_TOKENS = 65_536
GROUP_BLOCKS = 1024
POINTS = 64
ROUNDS = 6


class Exponent(NamedTuple):
    value: float
    norm: float  # the sum of share ** value


def n_tokens(text):
    """Words of a text; none without text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def exponent(sources: DataFrame, target_entropy: float, max_passes: float, budget_ratio: float) -> Exponent:
    """Bisect the exponent over ``sources`` (``share`` of the tokens, positive, adding up to one).

    ``target_entropy`` is a part of the largest entropy that many sources can have.
    """
    n = sources.count()
    goal = target_entropy * math.log(n) if n > 1 else 0.0

    def at(points: list[float]) -> list[tuple[bool, float]]:
        """Whether each point is high enough in entropy and in repetition too high, by point."""
        a = F.element_at(F.array(*map(F.lit, points)), F.col("i") + 1)
        power = F.pow("share", a)
        rows = (
            sources.select("share", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))).alias("i"))
            .groupBy("i")
            .agg(
                F.sum(power).alias("norm"),
                F.sum(power * a * F.log("share")).alias("logs"),
                F.max(power / F.col("share")).alias("rate"),
            )
            .collect()
        )
        found = {r["i"]: r for r in rows}
        out = []
        for i in range(len(points)):
            r = found[i]
            entropy = math.log(r["norm"]) - r["logs"] / r["norm"]
            out.append((entropy >= goal - 1e-12, budget_ratio * r["rate"] / r["norm"] <= max_passes + 1e-12, r["norm"]))
        return out

    def bisect(which: int, low: float, high: float, rising: bool) -> float:
        """The last point that still holds (falling) or the first one that does (rising)."""
        for _ in range(ROUNDS):
            points = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
            holds = [x[which] for x in at(points)]
            if rising:
                first = next((i for i, x in enumerate(holds) if x), POINTS)
                low, high = points[max(0, first - 1)], points[first]
            else:
                last = next((i for i in range(POINTS, -1, -1) if holds[i]), 0)
                low, high = points[last], points[min(POINTS, last + 1)]
            if low == high:
                break
        return round(high if rising else low, 9)

    if n == 0:
        return Exponent(1.0, 1.0)
    value = bisect(0, 0.0, 1.0, rising=False)
    if not at([value])[0][1]:
        value = bisect(1, value, 1.0, rising=True)
    return Exponent(value, at([value])[0][2])


def mix_sources(
    docs: DataFrame,
    target_entropy: float = TARGET_ENTROPY,
    max_passes: float = MAX_PASSES,
    budget_ratio: float = 1.0,
    seed: int = 17,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source``, ...) with how often each is taken.

    Adds ``n_tokens``, ``weight`` (of its source), ``block`` (place in the permutation) and
    ``n_copies``, in place of columns of these names. ``budget_ratio`` is the budget in
    tokens as a part of all tokens; the limit on passes binds unless every source would be
    over it. Null is a source of its own. A document without words has no tokens: it is
    taken with the passes of its source; a source without any tokens has weight 0 and no copies.
    Rows are counted one by one, repeated ones too, and all are returned. An empty table gives
    an empty result.
    """
    added = ["n_tokens", "weight", "block", "n_copies"]
    columns = [c for c in docs.columns if c not in added]
    rows = docs.select(
        F.struct(*columns).alias("row"),
        F.col("source").alias("mix_source"),
        n_tokens(F.col("text")).alias("n_tokens"),
        F.xxhash64(F.lit(seed), "doc_id", F.octet_length("text")).alias("draw"),
    )
    per_source = rows.groupBy("mix_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    per_source = save(per_source, "sources")
    total = per_source.agg(F.sum("tokens")).first()[0] or 0
    shares = per_source.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = exponent(shares, target_entropy, max_passes, budget_ratio)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a.value)) / F.lit(a.norm))
    budget = F.round(F.col("weight") * F.lit(budget_ratio * total)).cast("long")
    plan = (
        per_source.withColumn("weight", F.round(F.coalesce(weight, F.lit(0.0)), 9))
        .withColumn("budget", budget)
        .withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .withColumn("n_blocks", F.ceil((F.col("tokens") + F.col("rows")) / F.lit(block_tokens)))
        .withColumn("ordinary", F.greatest(F.least(F.lit(float(block_tokens)), F.col("tokens") / 8), F.lit(1.0)))
        .select("mix_source", "weight", "passes", "rest", "n_blocks", "ordinary")
    )
    rows = match(rows, plan, ["mix_source"])
    # The 53 highest bits of the hash, as a number in [0, 1), pick the block.
    unit = F.shiftrightunsigned("draw", 11).cast("double") / F.lit(float(2**53))
    behind = F.when(F.col("n_tokens") > F.col("ordinary"), 1 + F.floor(F.log2(F.col("n_tokens") / F.col("ordinary")))).otherwise(F.lit(0))
    rows = rows.withColumn("block", (behind * F.col("n_blocks") + F.floor(unit * F.col("n_blocks"))).cast("long"))
    blocks = (
        rows.groupBy("mix_source", "block")
        .agg(F.sum("n_tokens").alias("block_tokens"))
        .withColumn("block_group", F.floor(F.col("block") / GROUP_BLOCKS))
    )
    groups = blocks.groupBy("mix_source", "block_group").agg(F.sum("block_tokens").alias("group_tokens"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("group_start", F.sum("group_tokens").over(before("mix_source", "block_group")))
    starts = match(blocks, groups, ["mix_source", "block_group"]).select(
        "mix_source",
        "block",
        (
            F.coalesce("group_start", F.lit(0))
            + F.coalesce(F.sum("block_tokens").over(before("mix_source", "block_group", "block")), F.lit(0))
        ).alias("block_start"),
    )
    rows = match(rows, starts, ["mix_source", "block"])
    inside = Window.partitionBy("mix_source", "block").orderBy("draw", "row.doc_id").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("block_start") + F.sum("n_tokens").over(inside)
    more = ((reached <= F.col("rest")) & (F.col("rest") > 0)).cast("long")
    return rows.select("row.*", "n_tokens", "weight", "block", (F.col("passes") + more).cast("long").alias("n_copies"))


def realise(docs: DataFrame, **parameters) -> DataFrame:
    """The mixture itself: the columns of ``docs``, each document as often as it is taken."""
    columns = docs.columns
    mixed = mix_sources(docs.select(F.struct(*columns).alias("whole"), "doc_id", "text", "source"), **parameters)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))
    return mixed.filter("n_copies > 0").select("whole", copies).select("whole.*")
