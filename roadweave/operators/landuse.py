"""Land use of city blocks by ranked shares, and what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roadweave.operators.ranks import ranked
from roadweave.plans.loops import cut

#: Share of the developed blocks, and weights of centrality, intensity and exposure (those of the last two terms of industry are of their opposites).
SHARES = {"commercial": 0.12, "industrial": 0.12, "mixed_use": 0.23}
#: People, jobs and leisure places a hectare.
RATES = {"residential": (95.0, 0.0, 25.0), "commercial": (0.0, 170.0, 70.0), "industrial": (0.0, 90.0, 0.0), "mixed_use": (75.0, 95.0, 55.0)}


def _scores() -> dict[str, Column]:
    c, i, e = F.col("centrality"), F.col("intensity"), F.col("exposure")
    return {"commercial": 0.55 * c + 0.30 * i + 0.15 * e, "industrial": 0.50 * e + 0.35 * (1.0 - c) + 0.15 * (1.0 - i), "mixed_use": 0.45 * c + 0.35 * i + 0.20 * e}


def land_use(blocks: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(block_id, land_use, population, jobs, leisure) of blocks (block_id, area_m2, centrality, intensity, exposure, buildable), of which neighbours (a, b; both ways) share an edge.

    Of what can be built on, the best by each use's score get it in turn, each from what the uses before have left (ties by block_id; ranks are
    distributed); the rest are homes, but mixed beside industry. Other blocks are open space and hold nothing. A hectare's rates grow with intensity.
    """
    built = cut(blocks.where("buildable"))
    n, left, taken = built.count(), built, None
    for use, score in _scores().items():
        best = ranked(left.withColumn("_score", F.round(score, 9)), F.desc("_score"), "block_id").where(F.col("rank") <= max(1, round(n * SHARES[use]))).select("block_id", F.lit(use).alias("use"))
        best = cut(best)
        taken = best if taken is None else taken.unionByName(best)
        left = left.join(best, "block_id", "left_anti")
    beside = taken.where("use = 'industrial'").join(neighbours, F.col("block_id") == F.col("a")).select(F.col("b").alias("block_id"), F.lit(True).alias("beside")).distinct()
    x = blocks.join(taken, "block_id", "left").join(beside, "block_id", "left")
    use = F.when(~F.col("buildable"), "open_space").otherwise(F.coalesce("use", F.when(F.col("beside"), "mixed_use").otherwise("residential")))
    x = x.withColumn("land_use", use)
    size = F.col("area_m2") / 10_000.0 * (0.45 + 0.55 * F.col("intensity"))

    def holds(k: int) -> Column:
        out = F.lit(0)
        for name, rates in RATES.items():
            if rates[k]:
                out = F.when(F.col("land_use") == name, F.greatest(F.lit(1), F.floor(size * rates[k] + 0.5))).otherwise(out)
        return out.cast("long")

    return x.select("block_id", "land_use", holds(0).alias("population"), holds(1).alias("jobs"), holds(2).alias("leisure"))
