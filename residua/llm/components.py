"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import group_extreme, shared_root

#: Edges of a state that one task may step; a larger state is shuffled by its keys. Counted before every round.
ONE_TASK_EDGES = 200_000


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _two(edges: DataFrame, first: tuple[str, str], second: tuple[str, str], names: tuple[str, str] = ("u", "v")) -> DataFrame:
    """Each row as two rows; unlike a union, this reads the input once and keeps its partitions."""
    pair = lambda c: F.struct(F.col(c[0]).alias(names[0]), F.col(c[1]).alias(names[1]))
    return edges.select(F.inline(F.array(pair(first), pair(second))))


def _least(edges: DataFrame, small: bool) -> DataFrame:
    """Each row with the smallest v of its u as _m; in one task without a shuffle, else by salted minima."""
    if small:
        return edges.withColumn("_m", F.min("v").over(Window.partitionBy("u")))
    return group_extreme(edges, ["u"], "v", "_m")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    near = _least(_two(edges, ("u", "v"), ("v", "u")), small)
    return near.where("v > u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _two(_least(down, small), ("v", "_m"), ("u", "_m")).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node reachable.

    edges: columns u, v (long). Loops, repeated and reversed edges are allowed; rows with a null end are ignored. An
    empty table gives an empty table. A hub's neighbours are reduced by salted minima, never gathered in one task, and
    each round is checkpointed in the shared folder. Only two counters per round reach the driver. While a state has at
    most ONE_TASK_EDGES edges, a round runs as one stage of one task, since its shuffles would cost more than its work.
    """
    shared_root(edges.sparkSession)
    state = edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct().checkpoint()
    seen = _fingerprint(state)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        small = seen[0] <= ONE_TASK_EDGES
        start = state.coalesce(1) if small else state
        state = _small_star(_large_star(start, small), small).checkpoint()
        now = _fingerprint(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _two(state, ("u", "v"), ("v", "v"), ("node", "component")).distinct()
