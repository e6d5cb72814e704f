"""Schemas that drift between files (problem 5).

A pre-aggregated pass turns the records into a schema graph per record type and version:
nodes are dotted field paths, labelled with their JSON types, edges are nesting.  Every key is
a field, so the graphs are as large as the schemas, and where keys are data, as those.  Each
record type and pair of consecutive versions is matched on its own by similarity flooding
(Melnik et al.): name and type similarity is propagated along equal edges until it converges,
then one-to-one correspondences are selected by relative similarity.  The records are then cast and united under their latest names.

Defined results: bodies that are no JSON object, or lack a type or version, have no shape, and
stand in the united table as they are; versions order by their numbers, then as text; a field
that is null in all records of a version counts as absent there; a field with several JSON
types in one version changes type only if no type is shared with the version before; where
one field goes and one of its type comes, that is a rename whatever the names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.deepjson import dumps, loads
from ledgerloom.runtime import ship_package, spread, stage

_SHAPE = "record_type string, version string, parent string, path string, json_type string, records long"
_CHANGE = "record_type string, field string, change string, version string, new_field string"
#: None: every key of every object is a field.  Who knows that keys are data may set a number:
#: an object with more different keys than this, over all versions, is then a map
MAP_KEYS: int | None = None
#: levels of nesting after which paths start anew, from a short name of the object above, as
#: they would be as long as the depth; in the united table, an object further down is one value
LEVELS = 500
#: a correspondence is kept if it is at least this good beside the best of either field
RELATIVE = 0.7
#: cells of the united table that a batch may have
CELLS = 2_000_000


def json_type(v) -> str:
    """The JSON type, whole numbers apart (``integer``)."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "integer" if isinstance(v, int) and -(2**63) <= v < 2**63 else "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def record_type_of(o: dict) -> str | None:
    t = o.get("type")
    if not isinstance(t, str):
        return None
    if t == "attachment":
        a = o.get("attachment")
        return f"{t}/{a.get('type') if isinstance(a, dict) and isinstance(a.get('type'), str) else ''}"
    return t


def read_record(body) -> tuple[str, str, dict] | None:
    """(record type, version, record), or None for what is no record."""
    try:
        o = loads(body)
    except (ValueError, TypeError):
        return None
    if isinstance(o, dict) and (t := record_type_of(o)) is not None and isinstance(o.get("version"), str):
        return t, o["version"], o
    return None


def _short(path: str) -> str:
    return "\x01" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def fields(o: dict, is_map=lambda path: False, shorten=None):
    """(parent, path, value, whether its own fields follow) of all fields of a record; those
    below ``LEVELS`` only with ``shorten``, a dict that takes {short name: path} of the objects
    at which paths start anew."""
    todo = [("", o, 1)]
    while todo:
        parent, v, level = todo.pop()
        for k, x in v.items():
            path = f"{parent}.{k}" if parent else k
            inner = isinstance(x, dict) and bool(x) and (level < LEVELS or shorten is not None) and not is_map(path)
            yield parent, path, x, inner
            if inner and level % LEVELS:
                todo.append((path, x, level + 1))
            elif inner:
                short = _short(path)
                shorten[short] = path
                todo.append((short, x, level + 1))


def _shapes(batches, deep: bool):
    import pyarrow as pa

    names = [f.split()[0] for f in _SHAPE.split(", ")]
    shape: dict = defaultdict(int)
    clean = lambda s: s if s.isascii() else s.encode("utf-8", "replace").decode()

    def flush():
        cols = list(zip(*[(*map(clean, k), n) for k, n in shape.items()]))
        shape.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 5 else pa.string()) for i, c in enumerate(cols)], names=names)

    for b in batches:
        for body in b.column(0).to_pylist():
            if r := read_record(body):
                t, v, o = r
                shape[(t, v, "", "", "object")] += 1
                short = {} if deep else None
                for parent, path, x, _ in fields(o, shorten=short):
                    shape[(t, v, parent, path, json_type(x))] += 1
                for name, path in (short or {}).items():
                    shape[(t, v, path, name, "above")] += 1
                if len(shape) > 200_000:
                    yield flush()
    if shape:
        yield flush()


def schema_shapes(df: DataFrame, body: Column) -> tuple[DataFrame, DataFrame]:
    """(shapes, maps).  shapes: record_type, version, parent, path, json_type, records of every
    shape that occurs; path '' counts the records themselves, and where json_type is ``above``,
    path is the short name of the object ``parent``.  maps: record_type, path of the
    objects that are maps, whose keys are no fields (none unless ``MAP_KEYS`` is set)."""
    ship_package(df.sparkSession)
    deep = MAP_KEYS is None
    local = spread(df.select(body.alias("body")).where("body is not null"), "body").mapInArrow(lambda batches: _shapes(batches, deep), _SHAPE)
    shapes = stage(local.groupBy("record_type", "version", "parent", "path", "json_type").agg(F.sum("records").alias("records")), "p5-shapes")
    if MAP_KEYS is None:
        return shapes, shapes.where("false").select("record_type", "path")
    keys = shapes.where("path <> ''").groupBy("record_type", F.col("parent").alias("map")).agg(F.count_distinct("path").alias("n"))
    maps = stage(keys.where((F.col("n") > MAP_KEYS) & (F.col("map") != "")).select("record_type", "map"), "p5-maps")
    if not maps.isEmpty():
        a, b = maps.alias("a"), maps.alias("b")
        maps = a.join(b, (F.col("a.record_type") == F.col("b.record_type")) & F.startswith("a.map", F.concat("b.map", F.lit("."))), "left_anti")
        under = (shapes.record_type == maps.record_type) & F.startswith(shapes.path, F.concat(maps.map, F.lit(".")))
        shapes = stage(shapes.join(maps, under, "left_anti"), "p5-fields")
    return shapes, maps.select("record_type", F.col("map").alias("path"))


def version_key(v: str) -> tuple:
    return tuple(int(x) for x in re.findall(r"\d+", v)), v


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower())


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient over character trigrams of the names, case and joints aside, and over
    their words: the mean of both."""

    def dice(x: set, y: set) -> float:
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0

    def grams(ws: list[str]) -> set:
        s = f"  {''.join(ws)} "
        return {s[i : i + 3] for i in range(len(s) - 2)}

    wa, wb = _words(a), _words(b)
    return (dice(grams(wa), grams(wb)) + dice(set(wa), set(wb))) / 2


def _grams(name: str) -> set[str]:
    s = f"  {''.join(_words(name))} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def _leaf(path: str) -> str:
    return path.rpartition(".")[2]


class _NameIndex:
    """Names that are compared with another one all at once, as ``name_similarity`` does it."""

    def __init__(self, names: list[str]):
        import numpy as np

        self.n = len(names)
        self.by: tuple[dict, dict] = ({}, {})
        sizes = []
        for read, by in zip((_grams, lambda x: set(_words(x))), self.by):
            posts: dict = defaultdict(list)
            sizes.append(np.zeros(self.n, np.int64))
            for i, name in enumerate(names):
                found = read(name)
                sizes[-1][i] = len(found)
                for g in found:
                    posts[g].append(i)
            by.update((g, np.array(p)) for g, p in posts.items())
        self.sizes = sizes

    def compare(self, name: str):
        """(how many trigrams are shared, similarity) with each of the names."""
        import numpy as np

        shared, dice = [], []
        for found, by, size in zip((_grams(name), set(_words(name))), self.by, self.sizes):
            count = np.zeros(self.n, np.int64)
            for g in found:
                if (post := by.get(g)) is not None:
                    count[post] += 1
            total = len(found) + size
            shared.append(count)
            dice.append(np.where(total > 0, 2 * count / np.maximum(total, 1), 1.0))
        return shared[0], (dice[0] + dice[1]) / 2


class Flooding:
    """Similarity flooding between two schema graphs ``{path: json type}``.

    The nodes of the propagation graph are pairs of equal type: a field that stays with itself,
    and a field that goes with one that comes, if they nest in the same field or their names
    have a trigram in common; what is inside a field that goes is paired with what is inside
    the one that comes.  Two pairs are neighbours if both their fields nest in each other.  Each
    round adds what flows in from the neighbours to the initial similarity and scales to a
    maximum of 1.

    Pairs are not held one by one: those with the same parent pair, the same initial
    similarity and the same fields inside have equal scores in every round, so each such class
    is one node with the number of its pairs.  ``row`` gives the scores of one field.
    """

    def _up(self, path: str) -> str:
        up = path.rpartition(".")[0]
        return self.short.get(up, up)

    def _restarts(self, path: str) -> int:
        """How often the path started anew."""
        n = 0
        while (path := self.short.get(path.partition(".")[0])) is not None:
            n += 1
        return n

    def __init__(self, old: dict[str, str], new: dict[str, str], rounds: int = 100, eps: float = 1e-6, short: dict = {}):  # noqa: B006
        self.short = short
        a, b = {"": "object", **old}, {"": "object", **new}
        self.kept = [x for x in a if b.get(x) == a[x]]
        self.place = {x: i for i, x in enumerate(self.kept)}
        self.label = a
        # a shape is what is inside a field that goes or comes: (name, type, shape) of each
        self.shapes: list[tuple] = [()]
        self.shape: tuple[dict, dict] = ({}, {})
        known = {(): 0}
        tops = []
        for side, other, shape in ((a, b, self.shape[0]), (b, a, self.shape[1])):
            own, inside, top = side.keys() - other.keys(), defaultdict(list), []
            for p in sorted(own, key=lambda p: (self._restarts(p), len(p)), reverse=True):
                form = tuple(sorted(inside.pop(p, ())))
                if form not in known:
                    known[form] = len(self.shapes)
                    self.shapes.append(form)
                shape[p] = known[form]
                if self._up(p) in own:
                    inside[self._up(p)].append((_leaf(p), side[p], shape[p]))
                else:
                    top.append(p)
            tops.append(sorted(top))
        self.gone, come = tops
        self._come(come, b)
        self._classes()
        self._run(rounds, eps)

    def _come(self, come: list[str], b: dict[str, str]) -> None:
        """By type: (fields that come, index of their names, their parents, their shapes)."""
        import numpy as np

        by: dict = defaultdict(list)
        for y in come:
            by[b[y]].append(y)
        self.parents = {p: i for i, p in enumerate({self._up(y): 0 for y in come})}
        self.come = {}
        for t, ys in by.items():
            numbers = ([self.parents[self._up(y)] for y in ys], [self.shape[1][y] for y in ys])
            self.come[t] = (ys, _NameIndex([_leaf(y) for y in ys]), *map(np.array, numbers))

    def _partners(self, x: str):
        """(partners of ``x``: their numbers, classes, each partner's class, sizes of the classes)"""
        import numpy as np

        _, index, parents, shapes = self.come[self.label[x]]
        shared, start = index.compare(_leaf(x))
        same = parents == self.parents.get(self._up(x), -1)
        near = np.flatnonzero(same | (shared > 0))
        values, place = np.unique(start[near], return_inverse=True)
        n = len(self.shapes)
        codes, which, sizes = np.unique((place * n + shapes[near]) * 2 + same[near], return_inverse=True, return_counts=True)
        over, mine = self.place.get(self._up(x), -1), self.shape[0][x]
        classes = [(over if c % 2 else -1, float(values[c // 2 // n]), mine, c // 2 % n) for c in codes.tolist()]
        return near, classes, which, sizes

    def _inside(self, left: int, right: int, memo: dict) -> Counter:
        """{(initial similarity, shape, shape): pairs} of what is inside a pair of two shapes."""
        if (hit := memo.get((left, right))) is None:
            hit, by = Counter(), defaultdict(list)
            for name, t, shape in self.shapes[right]:
                by[t].append((name, shape))
            index = {t: _NameIndex([name for name, _ in of]) for t, of in by.items()}
            for name, t, shape in self.shapes[left]:
                if t in by:
                    shared, start = index[t].compare(name)
                    for i in shared.nonzero()[0].tolist():
                        hit[float(start[i]), shape, by[t][i][1]] += 1
            memo[left, right] = hit
        return hit

    def _classes(self) -> None:
        n = len(self.kept)
        self.start, self.size, self.pairs = [1.0] * n, [1] * n, [1] * n
        self.parent = [self.place.get(self._up(x), -1) if x else -1 for x in self.kept]
        tops: Counter = Counter()
        for x in self.gone:
            if self.label[x] in self.come:
                _, classes, _, sizes = self._partners(x)
                for c, k in zip(classes, sizes.tolist()):
                    tops[c] += k
        self.number: dict = {}
        memo: dict = {}
        todo = [(*c, k, c) for c, k in tops.items()]
        while todo:
            over, start, left, right, k, top = todo.pop()
            i = len(self.start)
            self.start.append(start)
            self.size.append(k)
            self.parent.append(over)
            self.pairs.append(k * (self.pairs[over] if over >= 0 else 1))
            if top:
                self.number[top] = i
            todo += [(i, *inner, m, None) for inner, m in self._inside(left, right, memo).items()]

    def _run(self, rounds: int, eps: float) -> None:
        import numpy as np

        start, size, pairs = (np.array(v, np.float64) for v in (self.start, self.size, self.pairs))
        parent = np.array(self.parent, np.int64)
        inner = np.flatnonzero(parent >= 0)
        over, n = parent[inner], len(start)
        kids = np.maximum(np.bincount(over, size[inner], n), 1)  # a parent shares its score among its pairs
        sim = start
        for _ in range(rounds):
            flow = np.bincount(over, size[inner] * sim[inner], n) / kids
            flow[inner] += sim[over] / kids[over]
            nxt = start + sim + flow
            nxt /= nxt.max()
            delta = (pairs * (nxt - sim) ** 2).sum()
            sim = nxt
            if delta < eps:
                break
        self.sim = sim

    def row(self, x: str):
        """The scores of ``x``, which goes, with all fields of its type that come; -1: no partner."""
        import numpy as np

        near, classes, which, _ = self._partners(x)
        scores = np.full(len(self.come[self.label[x]][0]), -1.0)
        scores[near] = self.sim[[self.number[c] for c in classes]][which]
        return scores

    def best_pairs(self, gone: list[str], come: list[str]) -> dict[str, str]:
        """One-to-one pairs of the fields of one type, the best first, of equal ones the first by
        name, as long as they are ``RELATIVE`` to the best that either field has."""
        import numpy as np

        wanted, going = set(come), set(gone)
        xs = [x for x in self.gone if x in going]
        if not xs or self.label[xs[0]] not in self.come:
            return {}
        ys = self.come[self.label[xs[0]]][0]
        free = np.array([y in wanted for y in ys])
        best_old, best_new = {}, np.full(len(ys), -1.0)
        for x in xs:
            scores = np.where(free, self.row(x), -1.0)
            best_old[x] = scores.max()
            best_new = np.maximum(best_new, scores)
        chosen: dict[str, str] = {}
        # each field waits with the best partner it had when last looked at
        heap = [(-best_old[x], x, -1) for x in xs if best_old[x] >= 0]
        heapq.heapify(heap)
        while heap:
            _, x, i = heapq.heappop(heap)
            if i >= 0 and free[i]:
                chosen[x] = ys[i]
                free[i] = False
                continue
            scores = self.row(x)
            scores[~free | (scores < RELATIVE * np.maximum(best_old[x], best_new))] = -1.0
            i = int(scores.argmax())
            if scores[i] >= 0:
                heapq.heappush(heap, (-scores[i], x, i))
        return chosen


def flood(old: dict[str, str], new: dict[str, str], rounds: int = 100, eps: float = 1e-6) -> dict[tuple[str, str], float]:
    """The scores of ``Flooding``, pair by pair."""
    f = Flooding(old, new, rounds, eps)
    sim = {(x, x): float(f.sim[i]) for i, x in enumerate(f.kept)}
    for x in f.gone:
        if f.label[x] in f.come:
            sim |= {(x, y): s for y, s in zip(f.come[f.label[x]][0], f.row(x).tolist()) if s >= 0}
    return sim


def select_renames(old: dict[str, str], new: dict[str, str], gone: list[str], come: list[str], short: dict = {}) -> dict[str, str]:  # noqa: B006
    """One-to-one correspondences of equal type between fields that went and fields that came.

    The only two of a type correspond.  Of several, pairs are taken by flooded similarity, the
    best first, as long as they are ``RELATIVE`` to the best that either field has.
    """
    left, right = defaultdict(list), defaultdict(list)
    for x in gone:
        left[old[x]].append(x)
    for y in come:
        right[new[y]].append(y)
    chosen = {left[t][0]: right[t][0] for t in left if len(left[t]) == 1 and len(right[t]) == 1}
    if all(x in chosen or not right[old[x]] for x in gone):
        return chosen
    flooded = Flooding(old, new, short=short)
    for t in left:
        if left[t][0] not in chosen:
            chosen |= flooded.best_pairs(left[t], right[t])
    return chosen


def _above(path: str, short: dict = {}):  # noqa: B006
    """The fields that ``path`` is inside of, the innermost first; ``short``: {short name: path}."""
    i = path.rfind(".")
    while i > 0:
        up = path[:i]
        if up in short:
            path = up = short[up]
            i = len(path)
        yield up
        i = path.rfind(".", 0, i)


def _whole(path: str, short: dict) -> str:
    """``path`` without short names."""
    parts = []
    while (head := path.partition(".")[0]) in short:
        parts.append(path[len(head) :])
        path = short[head]
    return "".join([path, *reversed(parts)])


def _compare(record_type: str, version: str, before: dict[str, set], now: dict[str, set], short: dict = {}) -> list[tuple]:  # noqa: B006
    out = []
    label = lambda s: "|".join(sorted(s))
    retyped = {p for p in before.keys() & now.keys() if not before[p] & now[p]}
    moved = retyped | (before.keys() ^ now.keys())
    inside = lambda p: any(q in moved for q in _above(p, short))
    gone = sorted(p for p in before.keys() - now.keys() if not inside(p))
    come = sorted(p for p in now.keys() - before.keys() if not inside(p))
    old, new = ({p: label(t) for p, t in s.items()} for s in (before, now))
    renames = select_renames(old, new, gone, come, short) if gone and come else {}
    for p in sorted(retyped):
        if not inside(p):
            out.append((record_type, p, "retyped", version, ""))
    for p in gone:
        out.append((record_type, p, "renamed", version, renames[p]) if p in renames else (record_type, p, "removed", version, ""))
    taken = set(renames.values())
    out += [(record_type, p, "added", version, "") for p in come if p not in taken]
    return out


def _ranked(versions: DataFrame) -> DataFrame:
    """(version, place, following) of the distinct versions, by their numbers."""

    def run(pdf):
        import pandas as pd

        vs = sorted(pdf["version"], key=version_key)
        return pd.DataFrame({"version": vs, "place": range(len(vs)), "following": [*vs[1:], None]})

    return versions.select("version").distinct().withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "version string, place long, following string")


def _compare_group(key, pdf):
    """The changes of one record type at one version, from its shapes before and now."""
    import pandas as pd

    record_type, at = key
    sides: dict = {True: defaultdict(set), False: defaultdict(set)}
    short: dict = {}
    for now, path, j, over in zip(pdf["now"], pdf["path"], pdf["json_type"], pdf["over"]):
        if j == "above":
            short[path] = over
            continue
        side = sides[bool(now)]
        side[""].add("object")
        if path and j != "null":
            side[path].add("number" if j == "integer" else j)
    before, now = sides[False], sides[True]
    if before and now:
        del before[""], now[""]
        out = [(t, _whole(p, short), c, v, _whole(q, short)) for t, p, c, v, q in _compare(record_type, at, before, now, short)]
    else:
        out = [(record_type, "", "type_added" if now else "type_removed", at, "")]
    return pd.DataFrame(out, columns=["record_type", "field", "change", "version", "new_field"])


def _changes(shapes: DataFrame) -> DataFrame:
    over = F.when(F.col("json_type") == "above", F.col("parent")).alias("over")
    ranked = shapes.select("record_type", "version", "path", "json_type", over).join(_ranked(shapes), "version")
    ways = F.array(
        F.struct(F.when(F.col("place") > 0, F.col("version")).alias("at"), F.lit(True).alias("now")),
        F.struct(F.col("following").alias("at"), F.lit(False).alias("now")),
    )
    sides = ranked.select("record_type", "path", "json_type", "over", F.explode(ways).alias("w")).select("record_type", "w.at", "w.now", "path", "json_type", "over")
    return sides.where("at is not null").groupBy("record_type", "at").applyInPandas(_compare_group, _CHANGE)


def report(df: DataFrame, body: Column) -> DataFrame:
    """(record_type, field, change, version, new_field); each record type and pair of versions
    is matched in a task of its own."""
    return _changes(schema_shapes(df, body)[0])


class Names:
    """The latest names of the fields: renames hold for the versions before them, and for
    everything inside a renamed object."""

    def __init__(self, renames: list[tuple[str, str, str, str]], versions: list[str]):
        self.place = {v: i for i, v in enumerate(sorted(versions, key=version_key))}
        self.by: dict = defaultdict(dict)
        for t, old, version, new in renames:
            self.by[t].setdefault(self.place[version], {})[old] = new
        for t, places in self.by.items():
            self.by[t] = dict(sorted(places.items()))
        self.known: dict = {}

    def latest(self, record_type: str, version: str, path: str) -> str:
        key = (record_type, version, path)
        if (hit := self.known.get(key)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            hit = path
            for place, renames in self.by.get(record_type, {}).items():
                if place > self.place.get(version, -1):
                    # nothing inside a renamed field is renamed at the same version
                    old = next((p for p in (hit, *_above(hit)) if p in renames), None)
                    hit = hit if old is None else renames[old] + hit[len(old) :]
            self.known[key] = hit
        return hit


_SQL_TYPE = {"string": "string", "integer": "long", "number": "double", "boolean": "boolean", "array": "string"}


def column_types(shapes: list[tuple[str, str, str, str]], names: Names) -> dict[str, str]:
    """{field: type} of the united table, from (record_type, version, path, json_type): a field
    has the type its newest version gives it; what several types claim is text."""
    newest: dict = {}
    for t, v, p, j in shapes:
        if p not in ("", "version") and j not in ("null", "object"):
            f, at = (t, names.latest(t, v, p)), names.place[v]
            have = newest.get(f)
            if have is None or at > have[0]:
                newest[f] = (at, {j})
            elif at == have[0]:
                have[1].add(j)
    types: dict = defaultdict(set)
    for (_, f), (_, js) in newest.items():
        types[f] |= {"double" if js == {"integer", "number"} else _SQL_TYPE[next(iter(js))] if len(js) == 1 else "string"}
    return {f: ("double" if ts == {"long", "double"} else next(iter(ts)) if len(ts) == 1 else "string") for f, ts in sorted(types.items())}


def as_text(v) -> str:
    return v if isinstance(v, str) else dumps(v, compact=True)


def cast(v, kind: str):
    """``v`` as a value of the column's type, or None if it is none."""
    if kind == "string":
        return as_text(v)
    if isinstance(v, str):
        v = v.strip()
        if kind == "boolean":
            return {"true": True, "false": False}.get(v)
        try:
            n = int(v) if kind == "long" and re.fullmatch(r"-?[0-9]{1,19}", v) else float(v) if kind == "double" and re.fullmatch(r"-?[0-9]{1,300}(\.[0-9]*)?([eE][+-]?[0-9]{1,3})?", v) else None
        except ValueError:
            return None
    elif isinstance(v, bool):
        return v if kind == "boolean" else None
    elif isinstance(v, (int, float)) and kind != "boolean":
        n = v
    else:
        return None
    if n is None or kind == "double":
        return None if n is None else float(n)
    return int(n) if n == int(n) and -(2**63) <= n < 2**63 else None


def unify(df: DataFrame, body: Column, keep: list[str]) -> DataFrame:
    """All records in one table: (keep..., record_type, version, one typed column a field,
    misfits).

    Fields carry their latest names, in code-point order after the fixed columns.  ``misfits``
    is a JSON object of the values that their column cannot hold, as text by latest name (for a
    body that is no record, the body itself under ``""``), so that nothing is lost or forced.
    An array, and a map, is text.
    """
    spark = df.sparkSession
    shapes, maps = schema_shapes(df, body)
    # all that comes to the driver is as large as the schemas
    renames = [(r.record_type, r.field, r.version, r.new_field) for r in _changes(shapes).where("change = 'renamed'").toLocalIterator()]
    flat = shapes.where("json_type <> 'above'")
    if MAP_KEYS is None:  # fields below LEVELS, whose paths start anew, are no columns
        anew = shapes.where("json_type = 'above'").select(F.col("path").alias("anew")).distinct()
        flat = flat.join(anew, F.substring_index("path", ".", 1) == F.col("anew"), "left_anti")
    seen = [tuple(r) for r in flat.select("record_type", "version", "path", "json_type").distinct().toLocalIterator()]
    mapped = {(r.record_type, r.path) for r in maps.toLocalIterator()}
    names = Names(renames, sorted({v for _, v, _, _ in seen}))
    seen += [(t, v, p, "string") for t, p in mapped for v in {v for u, v, q, _ in seen if u == t and q == p}]
    types = column_types(seen, names)
    fixed = [*keep, "record_type", "version"]
    taken = {c.lower() for c in [*fixed, "misfits"]}
    shown = {}
    for f in types:  # columns that differ in case only, or are named like a fixed one, are numbered
        n, i = f, 2
        while n.lower() in taken:
            n, i = f"{f}_{i}", i + 1
        taken.add(n.lower())
        shown[f] = n
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

    spark_types = {"string": StringType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}
    out_schema = StructType(
        [df.schema[k] for k in keep]
        + [StructField("record_type", StringType()), StructField("version", StringType())]
        + [StructField(shown[f], spark_types[k]) for f, k in types.items()]
        + [StructField("misfits", StringType())]
    )
    shared = spark.sparkContext.broadcast((names, types, mapped))

    def run(batches):
        import pyarrow as pa

        names, types, mapped = shared.value
        arrow = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        clean = lambda s: s if not isinstance(s, str) or s.isascii() else s.encode("utf-8", "replace").decode()
        step = max(1, CELLS // max(1, len(types)))
        for b in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            bodies = b.column(len(keep)).to_pylist()
            cols: dict[str, list] = defaultdict(lambda: [None] * len(bodies))  # noqa: B023
            blank = {k: pa.nulls(len(bodies), a) for k, a in arrow.items()}
            kinds, versions, odd = ([None] * len(bodies) for _ in range(3))
            for i, s in enumerate(bodies):
                r = read_record(s)
                if r is None:
                    odd[i] = None if s is None else as_text({"": s})
                    continue
                t, v, o = r
                kinds[i], versions[i] = t, v
                misfits = {}
                for _, path, x, inner in fields(o, lambda p: (t, p) in mapped):
                    if inner or x is None or path == "version":
                        continue
                    f = names.latest(t, v, path)
                    is_map = isinstance(x, dict) and (t, path) not in mapped
                    y = None if is_map or f not in types else cast(x, types[f])
                    if y is None:
                        misfits[f] = as_text(x)
                    else:
                        cols[f][i] = clean(y)
                if misfits:
                    odd[i] = as_text(dict(sorted(misfits.items())))
            text = [pa.array([clean(x) for x in c], pa.string()) for c in (kinds, versions, odd)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *text[:2], *[pa.array(cols[f], arrow[k]) if f in cols else blank[k] for f, k in types.items()], text[2]], names=out_schema.names)

    return df.select(*keep, body.alias("_body")).mapInArrow(run, out_schema)


def unreadable(united: DataFrame) -> DataFrame:
    """The rows of the united table whose body was no record."""
    return united.where("record_type is null")
