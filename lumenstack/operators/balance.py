"""Dealing rows out to tasks by weight: each task gets about the same total."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A row of more than this share of a task's part is placed by itself; there are at most tasks / SHARE of those.
SHARE = 0.125


def _placed(weights: list[int], tasks: int) -> tuple[list[int], list[int]]:
    """The heaviest first, each to the task with the least so far: (task of each, load of each task)."""
    loads = [(0, t) for t in range(tasks)]
    out = []
    for w in weights:
        load, t = heapq.heappop(loads)
        out.append(t)
        heapq.heappush(loads, (load + w, t))
    return out, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def _room(loads: list[int], rest: int) -> np.ndarray:
    """What each task takes of the rest, so that all that take any end at one level."""
    order = np.sort(np.array(loads, np.float64))
    below = np.arange(1, len(order) + 1) * order - np.cumsum(order)  # what lifts the lowest i + 1 tasks to the highest of them
    n = int(np.searchsorted(below, rest, "right"))
    level = order[n - 1] + (rest - below[n - 1]) / n
    return np.maximum(0, level - np.array(loads, np.float64))


def balanced(rows: DataFrame, tasks: int, key: str, weight: str, digits: int = 3) -> DataFrame:
    """rows with `task`, 0 to tasks - 1.

    Heavy rows, of which there can only be tasks / SHARE, are placed one by one; the rest fill up what is left, in the order of running sums.
    The sums are taken within chunks, by a hash of the key, and over the chunks' totals, so no task and not the driver sees all rows.
    Without one row that weighs more than a task's part, no task gets more than 1 + SHARE times that. Null and negative weights count as 0.
    """
    spark = rows.sparkSession
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("long")
    own = rows.withColumn("_w", w).withColumn("_chunk", F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, digits))
    total = own.agg(F.sum("_w")).first()[0] or 0
    heavy = F.col("_w") > max(1, SHARE * total / tasks)
    # Only weights come to the driver: at most tasks / SHARE of them, and a sum a chunk.
    counted = own.where(heavy).groupBy("_w").count().collect()
    order = sorted((r["_w"] for r in counted for _ in range(r["count"])), reverse=True)
    tasks_of, loads = _placed(order, tasks)
    chunks = {r["_chunk"]: r["s"] for r in own.where(~heavy).groupBy("_chunk").agg(F.sum("_w").alias("s")).collect()}
    before, at = {}, 0
    for c in sorted(chunks):
        before[c], at = at, at + chunks[c]
    bounds = np.cumsum(_room(loads, at))

    @F.pandas_udf("int")
    def filled(place: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(bounds, place.to_numpy(), "right"), tasks - 1)).astype("int32")

    starts = spark.createDataFrame(sorted(before.items()), "_chunk string, _start long")  # 16 ** digits rows at most
    within = Window.partitionBy("_chunk").orderBy(key)
    run = F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, -1))
    light = own.where(~heavy).join(F.broadcast(starts), "_chunk").withColumn("task", filled(F.coalesce(run, F.lit(0)) + F.col("_start")))
    # Heavy rows of one weight are alike: the i-th of them by key takes the i-th place of that weight.
    places: dict[int, list[int]] = {}
    for x, t in zip(order, tasks_of, strict=True):
        places.setdefault(x, []).append(t)
    known = spark.createDataFrame([(x, i + 1, t) for x, ts in places.items() for i, t in enumerate(ts)], "_w long, _nth int, task int")
    nth = F.row_number().over(Window.partitionBy("_w").orderBy(key))
    alone = own.where(heavy).withColumn("_nth", nth).join(F.broadcast(known), ["_w", "_nth"])
    return light.select(*rows.columns, "task").unionByName(alone.select(*rows.columns, "task"))
