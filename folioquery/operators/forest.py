"""Many entity schemas as ordered forests: which relationships can hold, which entities stay, and in what
order they are filled.

Relationships are admitted in the order of declaration. Trees under construction are kept as an
ordered union-find: each entity knows a way to its root and its depth below it, each root the
height of its tree, so whether a relationship closes a cycle or makes a tree too deep is
known without walking it. A schema is one group: its rows come sorted to one task, which holds its
entities and admitted relationships and nothing of other schemas.
"""

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Forest:
    """Trees over names: hang() puts a root under another tree's name."""

    def __init__(self, names: Iterable):
        self.up = {n: (n, 0) for n in names}
        self.height = dict.fromkeys(self.up, 1)

    def root(self, name) -> tuple:
        """(root, depth below it); names on the way point to the root afterwards."""
        way = []
        while self.up[name][0] != name:
            way.append(name)
            name = self.up[name][0]
        depth = 0
        for n in reversed(way):
            depth += self.up[n][1]
            self.up[n] = (name, depth)
        return name, depth

    def deep(self, parent, child) -> int:
        """Levels of the tree if ``child``, a root, hung under ``parent``, counted along the child."""
        return self.root(parent)[1] + 1 + self.height[child]

    def hang(self, parent, child) -> None:
        root, depth = self.root(parent)
        self.up[child] = (root, depth + 1)
        self.height[root] = max(self.height[root], depth + 1 + self.height[child])


def admitted(names: list, edges: list[tuple]) -> list[str]:
    """What becomes of each relationship (child, child_attribute, parent), in order: kept, or the first
    reason against it of unknown_parent, unknown_child, loop, duplicate (of a kept one),
    second_parent and cycle."""
    forest, seen, under, out = Forest(names), set(), set(), []
    for edge in edges:
        child, _, parent = edge
        if parent not in forest.up:
            out.append("unknown_parent")
        elif child not in forest.up:
            out.append("unknown_child")
        elif child == parent:
            out.append("loop")
        elif edge in seen:
            out.append("duplicate")
        elif child in under:
            out.append("second_parent")
        elif forest.root(parent)[0] == child:
            out.append("cycle")
        else:
            forest.hang(parent, child)
            seen.add(edge)
            under.add(child)
            out.append("kept")
    return out


def by_priority(names: list, edges: list[tuple]) -> list:
    """Names in the order in which they stay when there are too many. Trees with more relationships
    come first, then larger ones, then the one declared first; in a tree a level before the next,
    brothers after their parents' order, then by declaration. edges: those of a forest."""
    declared = {n: i for i, n in enumerate(names)}
    below: dict = {n: [] for n in names}
    roots = set(names)
    for child, _, parent in edges:
        below[parent].append(child)
        roots.discard(child)
    trees = []
    for root in roots:
        tree = [root]
        for n in tree:
            tree += sorted(below[n], key=declared.__getitem__)
        trees.append(tree)
    trees.sort(key=lambda t: (-len(t), min(map(declared.__getitem__, t))))  # a tree of n names has n - 1 relationships
    return [n for tree in trees for n in tree]


def too_deep(names: list, edges: list[tuple], most: int) -> list[bool]:
    """For each relationship of a forest, in order, whether it would make a tree of more than ``most``
    levels of those admitted before it."""
    forest, out = Forest(names), []
    for child, _, parent in edges:
        out.append(forest.deep(parent, child) > most)
        if not out[-1]:
            forest.hang(parent, child)
    return out


def parents_first(names: list, edges: list[tuple]) -> list:
    """Names in an order that puts parents first: those without parents in order, then each name when
    its last parent has come; what a cycle holds comes last, in order. Relationships to other names don't count."""
    waiting, below = dict.fromkeys(names, 0), {n: [] for n in names}
    for child, _, parent in edges:
        if parent in below and child in below:
            below[parent].append(child)
            waiting[child] += 1
    ready, out = deque(n for n in names if not waiting[n]), []
    while ready:
        out.append(ready.popleft())
        for child in below[out[-1]]:
            waiting[child] -= 1
            if not waiting[child]:
                ready.append(child)
    left = set(names) - set(out)
    return out + [n for n in names if n in left]


def enforced(names: list, edges: list[tuple], most_entities: int | None, most_depth: int | None) -> tuple[list[str], dict, dict]:
    """(each relationship's fate, each name's place by priority, each kept name's level and place of
    filling). The fates of admitted() and trimmed, too_deep."""
    fates = admitted(names, edges)
    alive = [i for i, f in enumerate(fates) if f == "kept"]
    order = by_priority(names, [edges[i] for i in alive])
    kept = set(order if most_entities is None else order[:most_entities])
    for i in alive:
        if not {edges[i][0], edges[i][2]} <= kept:
            fates[i] = "trimmed"
    stay = [n for n in names if n in kept]
    alive = [i for i in alive if fates[i] == "kept"]
    if most_depth is not None:
        for i, deep in zip(alive, too_deep(stay, [edges[i] for i in alive], most_depth)):
            if deep:
                fates[i] = "too_deep"
    final = [e for e, f in zip(edges, fates) if f == "kept"]
    forest = Forest(stay)
    for child, _, parent in final:
        forest.hang(parent, child)
    place = {n: (forest.root(n)[1] + 1, i) for i, n in enumerate(parents_first(stay, final))}
    return fates, {n: i for i, n in enumerate(order)}, place


_IN = "graph {0}, kind int, pos long, name string, child string, child_attribute string, parent string"
_OUT = ", priority long, level long, place long, fate string"


def _walked(entities: DataFrame, relationships: DataFrame, make) -> DataFrame:
    """One row for each input row, with what ``make(names, edges)`` says of it."""
    kind = dict(entities.dtypes)["graph"]
    none = F.lit(None).cast("string")
    rows = entities.select("graph", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("pos"), "name", none.alias("child"), none.alias("child_attribute"), none.alias("parent"))
    rows = rows.unionByName(relationships.select("graph", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), none.alias("name"), "child", "child_attribute", "parent"))
    rows = rows.repartition("graph").sortWithinPartitions("graph", "kind", "pos", "name", "child", "child_attribute", "parent")

    def walk(batches):
        held, schema = [], None

        def done():
            names = list(dict.fromkeys(r["name"] for r in held if not r["kind"] and r["name"] is not None))
            edges = [(r["child"], r["child_attribute"], r["parent"]) for r in held if r["kind"]]
            fates, priority, place = make(names, edges)
            fates, first = iter(fates), set(names)
            for r in held:
                said: dict = dict.fromkeys(("priority", "level", "place", "fate"))
                if r["kind"]:
                    said["fate"] = next(fates)
                elif r["name"] not in first:
                    said["fate"] = "unnamed" if r["name"] is None else "merged"
                else:
                    first.discard(r["name"])
                    said["priority"] = priority.get(r["name"])
                    said["level"], said["place"] = place.get(r["name"], (None, None))
                    said["fate"] = "kept" if r["name"] in place else "trimmed"
                yield r | said

        for b in batches:
            schema = b.schema
            for r in b.to_pylist():
                if held and held[0]["graph"] != r["graph"]:
                    yield from _batches(done(), schema)
                    held.clear()
                held.append(r)
        if held:
            yield from _batches(done(), schema)

    return rows.mapInArrow(walk, _IN.format(kind) + _OUT)


def _batches(rows, schema: pa.Schema, size: int = 5000):
    for c in ("priority", "level", "place"):
        schema = schema.append(pa.field(c, pa.int64()))
    schema, held = schema.append(pa.field("fate", pa.string())), []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def enforce(entities: DataFrame, relationships: DataFrame, most_entities: int | None = None, most_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of every schema, each row with its fate.

    entities: graph, pos, name; relationships: graph, pos, child, child_attribute, parent; pos is the order
    of declaration, equal ones go by their texts. Entities get ``priority`` (place in the order in which
    they stay), ``level`` (roots are 1) and ``place`` (parents first) among those kept, and fate: kept,
    trimmed, merged (a name declared before) or unnamed. Relationships get the fates of enforced().
    Relationships of a schema without entities are unknown_parent; an empty table gives empty ones.
    """
    rows = _walked(entities, relationships, lambda names, edges: enforced(names, edges, most_entities, most_depth))
    return (
        rows.where("kind = 0").select("graph", "pos", "name", "priority", "level", "place", "fate"),
        rows.where("kind = 1").select("graph", "pos", "child", "child_attribute", "parent", "fate"),
    )


def filling_order(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(graph, pos, name, place): parents first in any graph, also with several parents and cycles; names
    declared twice count once. Columns as in enforce()."""

    def make(names, edges):
        return ["kept"] * len(edges), {}, {n: (None, i) for i, n in enumerate(parents_first(names, edges))}

    return _walked(entities, relationships, make).where("kind = 0 and fate = 'kept'").select("graph", "pos", "name", "place")
