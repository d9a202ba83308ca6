"""Which scenes explain missing observation counts: the greedy choice of the largest that does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERED, NEGATIVE = 0.999, 0.0005


def explaining_scenes(masks: DataFrame, shortfall: DataFrame, keys: list[str], covered: float = COVERED, negative: float = NEGATIVE) -> list[int]:
    """Scenes (int) whose valid pixels account for the shortfall, in the order of choice.

    masks: keys and scene, a row for each valid pixel of a scene; shortfall: keys and missing, every pixel. A
    scene explains it if nearly all its pixels miss an observation, and nearly none would be below zero
    without it. The largest such scene is taken (the first of equals), its pixels are subtracted, and so on.
    Pixels are first counted by their scenes and shortfall, so that a round reads these counts and not pixels;
    a round brings one row to the driver, and there are no more rounds than scenes.
    """
    sets = masks.groupBy(*keys).agg(F.array_sort(F.collect_set("scene")).alias("scenes"))
    kinds = sets.join(shortfall, keys).groupBy("scenes", "missing").agg(F.count("*").alias("n")).persist()
    taken: list[int] = []
    try:
        while True:
            done = F.array(*[F.lit(s) for s in taken]).cast("array<int>")
            left = F.col("missing") - F.size(F.array_intersect("scenes", done))
            each = kinds.select(F.explode(F.array_except(F.col("scenes"), done)).alias("scene"), left.alias("left"), "n")
            by = each.groupBy("scene").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("left") >= 1, F.col("n")).otherwise(0)).alias("hit"), F.sum(F.when(F.col("left") < 1, F.col("n")).otherwise(0)).alias("under"))
            fit = by.where((F.col("hit") / F.col("n") >= covered) & (F.col("under") / F.col("n") <= negative))
            best = fit.orderBy(F.desc("n"), "scene").first()
            if best is None:
                return taken
            taken.append(best["scene"])
    finally:
        kinds.unpersist()
