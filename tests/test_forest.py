"""Schema enforcement against a plain version that walks whole graphs."""

import random
from collections import defaultdict

from folioquery.operators import forest as T
from folioquery.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def levels(names, edges):
    up = {c: p for c, _, p in edges}

    def level(n):
        return 1 + level(up[n]) if n in up else 1

    return {n: level(n) for n in names}


def plain(names, edges, most, depth):
    """Fates and the names that stay, by definition: every question is asked of the whole graph."""
    kept, fates = [], []
    for e in edges:
        c, _, p = e
        up, above = {x: y for x, _, y in kept}, p
        while above in up and above != c:
            above = up[above]
        fates.append(
            "unknown_parent" if p not in names else "unknown_child" if c not in names else "loop" if c == p else "duplicate" if e in kept
            else "second_parent" if c in up else "cycle" if above == c else "kept"
        )
        if fates[-1] == "kept":
            kept.append(e)
    group = {n: {n} for n in names}
    for c, _, p in kept:
        both = group[c] | group[p]
        for n in both:
            group[n] = both
    lv, order = levels(names, kept), []
    trees = {id(g): sorted(g, key=names.index) for g in group.values()}.values()
    for tree in sorted(trees, key=lambda g: (-sum(e[0] in g for e in kept), -len(g), names.index(g[0]))):
        row = [n for n in tree if lv[n] == 1]
        while row:
            order += row
            row = [n for r in row for n in tree if (any(e[0] == n and e[2] == r for e in kept))]
    stay = [n for n in names if n in order[:most]]
    final = []
    for i, e in enumerate(edges):
        if fates[i] != "kept":
            continue
        if not {e[0], e[2]} <= set(stay):
            fates[i] = "trimmed"
        elif max(levels(stay, [*final, e]).values()) > depth:
            fates[i] = "too_deep"
        else:
            final.append(e)
    return fates, order, stay, final


def made(seed):
    random.seed(seed)
    names = [f"n{i}" for i in random.sample(range(20), random.randrange(1, 12))]
    pool = [*names, "stranger"]
    return names, [(random.choice(pool), random.choice("ab"), random.choice(pool)) for _ in range(random.randrange(25))]


def test_enforced_equals_plain_version():
    seen = set()
    for seed in range(600):
        names, edges = made(seed)
        most, depth = random.randrange(1, 12), random.randrange(1, 5)
        fates, priority, place = T.enforced(names, edges, most, depth)
        want, order, stay, final = plain(names, edges, most, depth)
        assert fates == want and [n for n, _ in sorted(priority.items(), key=lambda x: x[1])] == order
        assert {n: level for n, (level, _) in place.items()} == levels(stay, final)
        at = {n: i for n, (_, i) in place.items()}
        assert sorted(at.values()) == list(range(len(stay))) and all(at[p] < at[c] for c, _, p in final)
        seen |= set(fates)
    assert seen == {"kept", "unknown_parent", "unknown_child", "loop", "duplicate", "second_parent", "cycle", "trimmed", "too_deep"}


def test_parents_first_with_cycles_and_many_parents():
    e = lambda *pairs: [(c, "k", p) for p, c in pairs]
    assert T.parents_first(["c", "b", "a", "l", "m"], e(("a", "b"), ("b", "c"), ("l", "m"), ("m", "l"))) == ["a", "b", "c", "l", "m"]
    assert T.parents_first(["d", "b", "c", "a"], e(("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "a"))) == ["a", "b", "c", "d"]
    assert T.parents_first([], []) == []


def test_long_chain_is_not_quadratic():
    names = [str(i) for i in range(100_000)]
    chain = [(str(i + 1), "k", str(i)) for i in range(99_999)]
    fates, _, place = T.enforced(names, chain[::-1] + [("0", "k", "99999")], None, 50_000)
    assert fates.count("too_deep") == 1 and fates[-1] == "cycle" and max(v for v, _ in place.values()) == 50_000


def test_tables(spark):
    names = [("g", 0, "a"), ("g", 1, "b"), ("g", 2, "c"), ("g", 3, "a"), ("g", 4, None), (None, 0, "x"), ("h", 0, "lone")]
    edges = [("g", 0, "b", "k", "a"), ("g", 1, "a", "k", "b"), ("g", 2, "c", "k", "b"), ("i", 0, "x", "k", "y"), (None, 1, "x", "k", None)]
    entities = spark.createDataFrame([(*n, 1) for n in names], "graph string, pos int, name string, kind int")
    links = spark.createDataFrame(edges, "graph string, pos int, child string, child_attribute string, parent string")
    ents, rels = T.enforce(entities, links, most_depth=2)
    got = {(r.graph, r.pos): (r.fate, r.level, r.place) for r in ents.collect()}
    assert got == {("g", 0): ("kept", 1, 0), ("g", 1): ("kept", 2, 2), ("g", 2): ("kept", 1, 1), ("g", 3): ("merged", None, None), ("g", 4): ("unnamed", None, None), (None, 0): ("kept", 1, 0), ("h", 0): ("kept", 1, 0)}
    assert {(r.graph, r.pos): r.fate for r in rels.collect()} == {("g", 0): "kept", ("g", 1): "cycle", ("g", 2): "too_deep", ("i", 0): "unknown_parent", (None, 1): "unknown_parent"}
    assert T.enforce(entities.limit(0), links.limit(0))[0].count() == 0
    order = {(r.graph, r.name): r.place for r in T.filling_order(entities, links).collect()}
    assert order["g", "a"] == 0 and order["g", "c"] == 2 and order["h", "lone"] == 0


def test_query_equals_plain_version(spark):
    """Both queries have SQL twins; here the graphs are also walked in whole."""
    from folioquery.plans.q_graph import brand_graphs

    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    entities, links = (df.collect() for df in brand_graphs(read))
    names, edges = defaultdict(list), defaultdict(list)
    for r in sorted(entities, key=lambda r: r.pos):
        names[r.graph].append(r.name)
    for r in sorted(links, key=lambda r: r.pos):
        edges[r.graph].append((r.pos, (r.child, r.child_attribute, r.parent)))
    got = {(r["graph"], r["pos"]): r["fate"] for r in catalog.queries()["schema_edge_fates"](spark, FOLDER).collect()}
    for g in names:
        fates = plain(names[g], [e for _, e in edges[g]], 15, 3)[0]
        assert [got[g, pos] for pos, _ in edges[g]] == fates
