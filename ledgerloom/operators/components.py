"""Connected components by contraction.

1. Every task contracts the edges it already holds with a local union-find (no shuffle),
   leaving one (node, local label) row per node seen.
2. One shuffle by node shows which local labels meet; only those meetings survive as edges
   of a much smaller label graph.
3. The label graph is solved by alternating large-star and small-star rounds, each a
   pre-aggregated shuffle; a star is what the rounds converge to, in O(log^2 n) rounds.

No group is ever collected: a component that spans half the table is only a label that
many rows share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import ship_package, stage


def _local_contract(batches):
    import pyarrow as pa

    parent: dict = {}

    def find(x):
        root = x
        while (p := parent[root]) != root:
            root = p
        while (p := parent[x]) != root:
            parent[x], x = root, p
        return root

    def flush():
        nodes = list(parent)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array([find(n) for n in nodes], pa.binary())], names=["node", "label"]
        )

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if x is None or y is None:
                continue
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            rx, ry = find(x), find(y)
            if rx != ry:
                if ry < rx:
                    rx, ry = ry, rx
                parent[ry] = rx
        if len(parent) > 2_000_000:  # bounded memory: emit a partial contraction, begin anew
            yield flush()
            parent.clear()
    if parent:
        yield flush()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a BINARY, b BINARY)`` to ``(node BINARY, component BINARY)``, one row per node.

    The component is named by one of its nodes.  Rows with a null end are ignored, loops
    and repeated edges are allowed, an empty input gives an empty result.
    """
    ship_package(edges.sparkSession)
    a, b = edges.columns[:2]
    local = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(_local_contract, "node binary, label binary")
    # a node has at most one label per task that saw it, so this set is bounded by the tasks
    seen = stage(local.groupBy("node").agg(F.min("label").alias("label"), F.collect_set("label").alias("labels")), "cc-seen")
    meets = seen.where(F.size("labels") > 1).select(F.col("label").alias("u"), F.explode("labels").alias("v")).where("u <> v").distinct()
    stars = _stars(meets, max_rounds)
    return seen.select("node", "label").join(stars, "label", "left").select("node", F.coalesce("root", "label").alias("component"))


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Alternating large-star / small-star on (u, v); returns (label, root)."""
    cur = stage(edges, "cc-e0")
    if cur.isEmpty():
        return cur.select(F.col("u").alias("label"), F.col("v").alias("root"))
    before = None
    for i in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is linked to the least node near u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u itself, is linked to the least one
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        cur = stage(small, f"cc-e{i + 1}")
        now = cur.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before and now[0] == now[1]:  # unchanged, and every node has one parent: stars
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = cur.select(F.col("u").alias("label"), F.col("v").alias("root"))
    return roots
