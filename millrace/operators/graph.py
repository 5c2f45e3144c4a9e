"""Bounded closure and chains over edge tables.

Rounds are separate jobs whose frontier is cut with ``checkpoint()``; visited pairs are removed by an anti join, so cycles end.
Only frontiers and visited pairs of at most ``MOST_BROADCAST`` rows are broadcast.  Everything else is joined by shuffles: the size of a compressed
file tells too little of its rows for Spark to choose, and what it broadcasts passes through the driver in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.session import ensure_checkpoint_dir

MOST_HOPS = 16
#: Most rows of one side of a round's join that are broadcast.
MOST_BROADCAST = 10_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as the side of a join that is broadcast if it has few rows, and shuffled else."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df.hint("merge")


def closure(edges: DataFrame, source: str, target: str, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, reached, depth): everything reachable from each seed, itself included at depth 0, at its least depth.

    Without seeds, paths are doubled each round, so the rounds grow with the logarithm of the longest way.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    hops = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).where(F.col("_from").isNotNull() & F.col("_to").isNotNull()).distinct()
    if seeds is None:
        return _doubled(hops, max_depth)
    hops = hops.checkpoint()
    seen = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().select("node", F.col("node").alias("reached"), F.lit(0).alias("depth")).checkpoint()
    front, depth = seen, 0
    known = new = seen.count()
    while max_depth is None or depth < max_depth:
        depth += 1
        step = hops.join(_sized(front, new), F.col("reached") == F.col("_from")).select("node", F.col("_to").alias("reached")).distinct()
        front = step.join(_sized(seen, known), ["node", "reached"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        new = front.count()
        if not new:
            break
        seen, known = seen.unionByName(front), known + new
    return seen


def _doubled(hops: DataFrame, max_depth: int | None) -> DataFrame:
    nodes = hops.select(F.col("_from").alias("node")).union(hops.select("_to")).distinct()
    least = lambda df: df.groupBy("node", "reached").agg(F.min("depth").alias("depth"))
    seen = least(nodes.select("node", F.col("node").alias("reached"), F.lit(0).alias("depth")).unionByName(hops.select(F.col("_from").alias("node"), F.col("_to").alias("reached"), F.lit(1).alias("depth"))))
    if max_depth is not None:
        seen = seen.where(F.col("depth") <= max_depth)
    seen, state, reach = seen.checkpoint(), None, 1
    while max_depth is None or reach < max_depth:
        later = seen.select(F.col("node").alias("reached"), F.col("reached").alias("_end"), F.col("depth").alias("_more"))
        longer = seen.join(later.hint("merge"), "reached").select("node", F.col("_end").alias("reached"), (F.col("depth") + F.col("_more")).alias("depth"))
        if max_depth is not None:
            longer = longer.where(F.col("depth") <= max_depth)
        seen = least(longer).checkpoint()
        now = tuple(seen.agg(F.count("*"), F.sum("depth")).first())
        if now == state:
            break
        state, reach = now, reach * 2
    return seen


def chain(edges: DataFrame, node: str, parent: str, most: int = MOST_HOPS) -> DataFrame:
    """(node, chain): each node's line of parents, at most ``most`` hops, ending at a repeat or a missing parent.

    Each node has one parent, so every round is one equi-join; all rounds are one plan, as their number is fixed.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    parents = edges.select(F.col(node).alias("_child"), F.col(parent).alias("_parent")).groupBy("_child").agg(F.min("_parent").alias("_parent"))
    known = parents.select(F.col("_child").alias("_known"))
    walk = parents.select(F.col("_child").alias("node"), F.array("_child").alias("chain"), F.col("_child").alias("_at"))
    done = None
    for hop in range(most):
        step = walk.join(parents, F.col("_at") == F.col("_child"), "left").join(known, F.col("_parent") == F.col("_known"), "left")
        on = F.col("_known").isNotNull() & ~F.array_contains("chain", F.col("_parent"))
        step = step.select("node", F.when(on, F.concat("chain", F.array("_parent"))).otherwise(F.col("chain")).alias("chain"), F.when(on, F.col("_parent")).alias("_at"))
        if hop % 4 == 3:
            step = step.checkpoint()
        ended = step.where(F.col("_at").isNull()).select("node", "chain")
        done = ended if done is None else done.unionByName(ended)
        walk = step.where(F.col("_at").isNotNull())
        if hop % 4 == 3 and walk.isEmpty():
            return done
    return done.unionByName(walk.select("node", "chain"))
