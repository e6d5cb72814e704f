"""Parent-child links to full hierarchies (problem 1).

Components are found by contraction, small ones are co-located and walked by an iterative
depth-first traversal with white/grey/black colouring; a grey target is a back edge and
closes a cycle.  A component above ``max_component`` nodes is never put into one task: roots,
depths and paths come from pointer doubling along the parents (log2(depth) joins), the
depth-first intervals from ranking the Euler tour, a list of two events a node, by pointer
doubling too.  Both ways give the same rows.

Defined results: null or blank ids are no nodes; a node delivered several times keeps the
parent of its first delivery (order, then key); a parent that is no node makes the child
``dangling`` and a root of depth 0; a node that is its own parent is a cycle of length 1;
on and under a cycle, depth counts from the cycle's least node and the cycle as root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ids import uuid_key, uuid_text
from ledgerloom.operators.components import connected_components
from ledgerloom.operators.ordered import value_before
from ledgerloom.runtime import ship_package, stage

_OUT = (
    "node binary, parent binary, component binary, root binary, depth long, kind string, "
    "pre long, last long, descendants long, path array<binary>"
)


def _walk(with_path: bool):
    def run(batches):
        import pyarrow as pa

        binary, long = pa.binary(), pa.int64()
        types = [binary, binary, binary, binary, long, pa.string(), long, long, long, pa.list_(binary)]
        names = [f.split()[0] for f in _OUT.split(", ")]
        out: list[list] = [[] for _ in names]

        def emit():
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            for c in out:
                c.clear()
            return b

        comp, parent = None, {}
        for b in batches:
            for n, p, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if c != comp and parent:
                    _traverse(parent, comp, out, with_path)
                    parent = {}
                    if len(out[0]) >= (2_000 if with_path else 50_000):
                        yield emit()
                comp = c
                parent[n] = p
        if parent:
            _traverse(parent, comp, out, with_path)
        if out[0]:
            yield emit()

    return run


def _traverse(parent: dict, comp, out: list[list], with_path: bool) -> None:
    """One component: colour along the parents to find cycles, then walk down from each root."""
    colour, on_cycle, heads = {}, {}, []
    for start in parent:
        trail, x = [], start
        while x in parent and x not in colour:
            colour[x] = 1  # grey: on the current trail
            trail.append(x)
            x = parent[x]
        if x in parent and colour[x] == 1:  # a back edge: the trail from x on is a cycle
            ring = trail[trail.index(x) :]
            head = min(ring)
            heads.append(head)
            for y in ring:
                on_cycle[y] = head
        for y in trail:
            colour[y] = 2
    kids: dict = {}
    roots = []
    for n, p in parent.items():
        if n in on_cycle:
            if on_cycle[n] == n:
                roots.append(n)
            else:  # inside the ring every other member hangs below its parent
                kids.setdefault(p, []).append(n)
        elif p is None or p not in parent:
            roots.append(n)
        else:
            kids.setdefault(p, []).append(n)
    clock = 0
    for r in sorted(roots):
        ring_root = r in on_cycle
        stack, rows, path = [(r, 0)], [], []
        opened: list[tuple] = []
        while stack:
            n, d = stack.pop()
            while opened and opened[-1][1] >= d:
                rows[opened.pop()[0]][7] = clock - 1
            del path[d:]
            path.append(n)
            p = parent[n]
            kind = (
                "cycle"
                if n in on_cycle
                else "under_cycle"
                if ring_root
                else "dangling"
                if p is not None and p not in parent
                else "root"
                if p is None
                else "node"
            )
            opened.append((len(rows), d))
            rows.append([n, p, comp, r, d, kind, clock, 0, 0, list(path) if with_path else None])
            clock += 1
            for k in sorted(kids.get(n, ()), reverse=True):
                stack.append((k, d + 1))
        for i, _ in opened:
            rows[i][7] = clock - 1
        for row in rows:
            row[8] = row[7] - row[6]
            for c, v in zip(out, row):
                c.append(v)


def nodes_of(df: DataFrame, node: str, parents: list[str], order: list[str]) -> DataFrame:
    """One row per node: (node, parent) keys, the parent being the first of ``parents`` that
    is neither null nor blank in the first delivery by ``order``."""
    first = F.coalesce(*[uuid_key(F.col(p)) for p in parents])
    links = df.select(uuid_key(F.col(node)).alias("node"), F.struct(*order, first.alias("parent")).alias("d"))
    return links.where("node is not null").groupBy("node").agg(F.min("d").alias("d")).select("node", F.col("d.parent").alias("parent"))


def resolve_hierarchy(
    df: DataFrame, node: str, parents: list[str], order: list[str], with_path: bool = False, max_component: int = 200_000
) -> DataFrame:
    """The forest of ``df``: (node, parent, component, root, depth, kind, pre, last, descendants, path).

    ``pre``/``last`` number the nodes of a component in depth-first order: the descendants of
    x are the rows of its component with ``pre`` in (x.pre, x.last].  ``path`` is null unless
    ``with_path``.  ``max_component`` bounds what one task holds, and changes no row.
    """
    ship_package(df.sparkSession)
    first = F.coalesce(*[uuid_key(F.col(p)) for p in parents])
    edges = df.select(uuid_key(F.col(node)).alias("a"), first.alias("b")).where("a is not null and b is not null")
    comps = connected_components(edges)
    nodes = nodes_of(df, node, parents, order)
    placed = stage(
        nodes.join(comps, "node", "left").select("node", "parent", F.coalesce("component", "node").alias("component")), "p1-placed"
    )
    giants = stage(placed.groupBy("component").count().where(F.col("count") > max_component).select("component"), "p1-giants")
    small = placed
    has_giants = not giants.isEmpty()
    if has_giants:
        small = placed.join(giants, "component", "left_anti").select("node", "parent", "component")
    walked = small.repartition("component").sortWithinPartitions("component").mapInArrow(_walk(with_path), _OUT)
    if has_giants:
        walked = walked.unionByName(_spread_walk(placed.join(giants, "component", "left_semi"), with_path))
    return walked


def _climb(forest: DataFrame, with_path: bool, label: str) -> DataFrame:
    """(node, up, root, depth, path) after pointer doubling from (node, up).

    Every node holds an ancestor ``up``, its distance and the nodes on the way; a round jumps
    to the ancestor's ancestor.  ``up`` is null where the chain ended; what still jumps after
    every chain must have ended runs into a cycle, and has no root.
    """
    top = F.col("up").isNull()
    way = F.array("node") if with_path else F.lit(None)
    cur = stage(
        forest.select("node", "up", F.when(top, F.col("node")).alias("root"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), way.cast("array<binary>").alias("path")),
        f"{label}-0",
    )
    for i in range(cur.count().bit_length()):
        moving, done = cur.where("up is not null"), cur.where("up is null")
        if moving.isEmpty():
            break
        hop = cur.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        nxt = moving.join(hop, "up").select(
            "node", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), F.concat("path", "path2").alias("path")
        )
        cur = stage(done.unionByName(nxt), f"{label}-{i + 1}")
    return cur


def _ring_heads(ring: DataFrame) -> DataFrame:
    """The least node of each ring of (node, up), by doubling round the rings."""
    cur = stage(ring.select("node", "up", F.col("node").alias("least")), "p1-ring-0")
    for i in range(cur.count().bit_length()):
        hop = cur.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        cur = stage(cur.join(hop, "up").select("node", F.col("up2").alias("up"), F.least("least", "least2").alias("least")), f"p1-ring-{i + 1}")
    return cur.where(F.col("least") == F.col("node")).select("node", F.lit(True).alias("head"))


def _intervals(forest: DataFrame) -> DataFrame:
    """(node, pre, last, descendants) of a forest (node, up, component) in depth-first order.

    The Euler tour enters and leaves every node once.  ``ahead`` counts the nodes entered from
    an event to the end of its component's tour.
    """
    enter = lambda c: F.concat(F.col(c), F.lit(b"\x00"))
    leave = lambda c: F.concat(F.col(c), F.lit(b"\x01"))
    # siblings, and the roots of a component, follow each other in the order of their keys
    sib = stage(value_before(forest.select("node", "up", "component"), ["component", "up"], ["node"], "node", "before"), "p1-siblings")
    after = sib.where("before is not null").select(F.col("before").alias("node"), F.col("node").alias("after"))
    first = sib.where("before is null and up is not null").select(F.col("up").alias("node"), F.col("node").alias("child"))
    n = sib.join(after, "node", "left").join(first, "node", "left")
    ways = F.array(
        F.struct(enter("node").alias("event"), F.coalesce(enter("child"), leave("node")).alias("next"), F.lit(1).cast("long").alias("ahead")),
        F.struct(leave("node").alias("event"), F.coalesce(enter("after"), leave("up")).alias("next"), F.lit(0).cast("long").alias("ahead")),
    )
    cur = stage(n.select(F.explode(ways).alias("w")).select("w.*"), "p1-tour-0")
    for i in range(cur.count().bit_length()):
        moving, done = cur.where("next is not null"), cur.where("next is null")
        if moving.isEmpty():
            break
        hop = cur.select(F.col("event").alias("next"), F.col("next").alias("next2"), F.col("ahead").alias("ahead2"))
        nxt = moving.join(hop, "next").select("event", F.col("next2").alias("next"), (F.col("ahead") + F.col("ahead2")).alias("ahead"))
        cur = stage(done.unionByName(nxt), f"p1-tour-{i + 1}")
    node, entered = F.expr("substring(event, 1, length(event) - 1)"), F.expr("substring(event, length(event), 1)") == F.lit(b"\x00")
    ranks = cur.groupBy(node.alias("node")).agg(F.max(F.when(entered, F.col("ahead"))).alias("a"), F.max(F.when(~entered, F.col("ahead"))).alias("z"))
    sizes = forest.groupBy("component").agg(F.count("*").alias("n"))
    pre, below = F.col("n") - F.col("a"), F.col("a") - F.col("z") - 1
    return forest.select("node", "component").join(ranks, "node").join(sizes, "component").select("node", pre.alias("pre"), (pre + below).alias("last"), below.alias("descendants"))


def _spread_walk(nodes: DataFrame, with_path: bool) -> DataFrame:
    """What ``_walk`` gives, for components too large for one task: one row per node in every
    table but the tour, and as many rounds of joins as lengths have binary digits."""
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("has"))
    base = stage(nodes.join(known, "parent", "left").select("node", "parent", "component", F.when(F.col("has"), F.col("parent")).alias("up")), "p1-base")
    climbed = _climb(base, False, "p1-climb")
    # an unfinished node has jumped further than there are nodes, so it stands on a cycle; a ring
    # member has only turned round its ring, so every ring member is where some member stands
    ring = stage(climbed.where("up is not null").select(F.col("up").alias("node")).distinct(), "p1-ring")
    forest = base.withColumns({"on_ring": F.lit(False), "under": F.lit(False)})
    if not ring.isEmpty():
        heads = _ring_heads(base.join(ring, "node", "left_semi"))
        below = climbed.where("up is not null").select("node", F.lit(True).alias("below"))
        marked = base.join(ring.withColumn("ring", F.lit(True)), "node", "left").join(below, "node", "left").join(heads, "node", "left")
        forest = stage(
            marked.select(
                "node", "parent", "component", F.when(F.col("head").isNull(), F.col("up")).alias("up"), F.coalesce("ring", F.lit(False)).alias("on_ring"), F.coalesce("below", F.lit(False)).alias("under")
            ),
            "p1-forest",
        )
    if with_path:
        climbed = _climb(forest, True, "p1-path")
    elif not ring.isEmpty():  # what ended above stays
        climbed = climbed.where("up is null").unionByName(_climb(forest.where("under"), False, "p1-under"))
    kind = (
        F.when(F.col("on_ring"), "cycle")
        .when(F.col("under"), "under_cycle")
        .when(F.col("parent").isNull(), "root")
        .when(F.col("up").isNull(), "dangling")
        .otherwise("node")
    )
    res = forest.join(climbed.select("node", "root", "depth", "path"), "node").join(_intervals(forest), "node")
    return res.select("node", "parent", "component", "root", "depth", kind.alias("kind"), "pre", "last", "descendants", F.reverse("path").alias("path"))


def tree_table(h: DataFrame) -> DataFrame:
    """Keys as text, the path as ``root/.../node`` (null where none was asked for)."""
    return h.select(
        uuid_text(F.col("node")).alias("uuid"),
        uuid_text(F.col("parent")).alias("parent_uuid"),
        uuid_text(F.col("root")).alias("root_uuid"),
        "depth",
        "kind",
        "descendants",
        "pre",
        "last",
        uuid_text(F.col("component")).alias("component"),
        F.when(F.col("path").isNotNull(), F.concat_ws("/", F.transform("path", lambda x: uuid_text(x)))).alias("path"),
    )


def faulty_links(h: DataFrame) -> DataFrame:
    """(uuid, kind) of the nodes on a cycle, under one, or with a parent that is no node."""
    return h.where(F.col("kind").isin("cycle", "under_cycle", "dangling")).select(uuid_text(F.col("node")).alias("uuid"), "kind")


def descendants(h: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) by depth-first intervals: every node's ancestors are
    its own path, so the pairs come from the path and no range join is needed."""
    pairs = h.select("node", "depth", F.posexplode("path").alias("at", "ancestor")).where(F.col("ancestor") != F.col("node"))
    return pairs.select(uuid_text(F.col("ancestor")).alias("ancestor"), uuid_text(F.col("node")).alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))
