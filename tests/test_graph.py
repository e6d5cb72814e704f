"""Components and hierarchies against plain Python."""

import random
import uuid

import pytest

from ledgerloom.operators import hierarchy as H
from ledgerloom.operators.components import connected_components

SCHEMA = "uuid string, parentUuid string, logicalParentUuid string, received_at int, rec_id int, node string, component int, path string"


def table(spark, rows):
    """rows: (uuid, parent, logical); more columns have names that the operator uses itself."""
    return spark.createDataFrame([(u, p, q, i, i, "x", 1, None) for i, (u, p, q) in enumerate(rows)], SCHEMA)


def ids(n, seed=0):
    r = random.Random(seed)
    return [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(n)]


def brute(rows):
    parent = {}
    for u, p, q in rows:
        if u and u.strip() and u not in parent:
            parent[u] = next((x for x in (p, q) if x and x.strip()), None)
    kind = {}
    for u in parent:
        seen, x = [], u
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in parent:
            kind[u] = "cycle" if x == u else "under_cycle"
            if kind[u] == "under_cycle" and u in seen[seen.index(x) :]:
                kind[u] = "cycle"
        elif parent[u] is not None and parent[u] not in parent:
            kind[u] = "dangling"
    return kind


def run(spark, rows, **kw):
    h = H.resolve_hierarchy(table(spark, rows), "uuid", ["parentUuid", "logicalParentUuid"], ["received_at", "rec_id"], **kw)
    return {r.uuid: r.kind for r in H.faulty_links(h).collect()}, h


def test_spellings_are_one_value(spark):
    a, b = ids(2)
    rows = [("{" + a.upper() + "}", None, None), (" urn:uuid:" + a, None, None), (b, "  ", a), (None, a, None), ("  ", a, None)]
    faults, h = run(spark, rows)
    assert faults == {}
    got = {r.uuid: (r.parent_uuid, r.depth, r.descendants) for r in H.tree_table(h).collect()}
    assert got == {a: (None, 0, 1), b: (a, 1, 0)}


def test_faulty_links(spark):
    a, b, c, d, e, f, g = ids(7)
    rows = [(a, a, None), (b, c, None), (c, b, None), (d, b, None), (e, d, None), (f, g + "0", None), (g, f, None)]
    faults, _ = run(spark, rows)
    assert faults == {a: "cycle", b: "cycle", c: "cycle", d: "under_cycle", e: "under_cycle", f: "dangling"}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_random_forests(spark, bound):
    """Both ways, the walk and pointer doubling, against brute force."""
    r = random.Random(3)
    n = ids(300, 1)
    rows = []
    for i, u in enumerate(n):
        k = r.random()
        p = None if k < 0.05 else r.choice(n) if k < 0.12 else "missing" if k < 0.15 else n[max(0, i - 1 - int(r.expovariate(0.5)))]
        rows.append((u, p, None))
    rows += rows[:40]  # delivered again
    faults, h = run(spark, rows, max_component=bound)
    assert faults == brute(rows)
    depth = {x.uuid: x.depth for x in H.tree_table(h).collect() if x.kind in ("node", "root", "dangling")}
    parent = {u: p for u, p, _ in rows}
    for u, dep in depth.items():
        x, k = u, 0
        while parent.get(x) in parent:
            x, k = parent[x], k + 1
        assert k == dep


@pytest.mark.parametrize("with_path", [True, False])
def test_a_component_too_large_for_a_task_gives_the_same_rows(spark, with_path):
    r = random.Random(11)
    n = ids(160, 6)
    rows = [(n[0], None, None), *((u, n[0], None) for u in n[1:20])]  # a hot parent
    for i, u in enumerate(n[20:120], 20):
        k = r.random()
        rows.append((u, r.choice(n) if k < 0.1 else r.choice(["lost", "gone"]) if k < 0.2 else n[max(0, i - 1 - int(r.expovariate(0.4)))], None))
    rows += [(u, n[120 + (i + 1) % 7], None) for i, u in enumerate(n[120:127])] + [(n[127], n[127], None)]  # rings
    rows += [(u, n[r.randrange(120, i)], None) for i, u in enumerate(n[128:], 128)]
    rows += [(n[130], n[3], None), (n[131], "lost", None)]  # delivered again with other parents
    one, many = (sorted((tuple(x) for x in run(spark, rows, with_path=with_path, max_component=b)[1].collect()), key=repr) for b in (200_000, 0))
    assert {x[5] for x in one} == {"root", "node", "dangling", "cycle", "under_cycle"}
    assert many == one


def test_paths_and_intervals(spark):
    a, b, c, d = ids(4, 5)
    _, h = run(spark, [(a, None, None), (b, a, None), (c, b, None), (d, a, None)], with_path=True)
    rows = {r.uuid: r for r in H.tree_table(h).collect()}
    assert rows[c].path == f"{a}/{b}/{c}" and rows[a].descendants == 3
    below = {r.uuid for r in rows.values() if rows[a].pre < r.pre <= rows[a].last}
    assert below == {b, c, d}
    pairs = {(r.ancestor, r.descendant, r.distance) for r in H.descendants(h).collect()}
    assert pairs == {(a, b, 1), (a, c, 2), (b, c, 1), (a, d, 1)}


def test_long_chain_is_walked_without_recursion(spark):
    n = ids(5000, 9)
    _, h = run(spark, [(u, n[i - 1] if i else None, None) for i, u in enumerate(n)])
    assert h.agg({"depth": "max", "descendants": "max"}).first()[:] in ((4999, 4999),)


def test_empty_table(spark):
    faults, h = run(spark, [])
    assert faults == {} and h.count() == 0


def test_first_delivery_gives_the_parent(spark):
    a, b, c = ids(3, 4)
    _, h = run(spark, [(a, None, None), (b, None, None), (c, b, None), (c, a, None)])
    assert {r.uuid: r.parent_uuid for r in H.tree_table(h).collect()}[c] == b


def test_components_match_union_find(spark):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(0, i) for i in range(1, 60)]  # and a hot node
    enc = lambda i: i.to_bytes(4, "big")
    df = spark.createDataFrame([(bytearray(enc(a)), bytearray(enc(b))) for a, b in edges] + [(None, bytearray(b"x"))], "a binary, b binary").repartition(7)
    got = {bytes(x.node): bytes(x.component) for x in connected_components(df).collect()}
    f = {}

    def find(x):
        while f.setdefault(x, x) != x:
            x = f[x]
        return x

    for a, b in edges:
        f[find(a)] = find(b)
    nodes = {x for e in edges for x in e}
    assert set(got) == {enc(x) for x in nodes}
    for a in nodes:
        for b in nodes:
            assert (got[enc(a)] == got[enc(b)]) == (find(a) == find(b))
