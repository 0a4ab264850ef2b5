"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Each text becomes a set of hashed word shingles; its K least hashes are the sketch.
   Equal sets are collapsed by digest, which is the set's name from then on.
2. Inverted lists of retained values bring together sets that share one. Two sets at the
   threshold share ``needed`` values or more, so each set can leave out that many less one
   of its values, the most frequent ones, and still meets the other under the rarest value
   of both: a passage that many sets hold makes no long list. In a list,
   the share of common values among the K least of both (a union sketch) estimates the
   similarity; only pairs far below the threshold are put aside (chance under 1e-9 for a
   pair at the threshold). A list gives a star for each component of its graph, not pairs.
3. Components of those edges are clusters of candidates. Their full sets are read again
   and compared exactly, block against block, again giving stars only; components of
   the confirmed links are the result.

A list or cluster too large for one task is cut into blocks (``linked``). Blocks are linked
inside first; then only the rows outside the group's largest component so far go to every
block, so that all pairs that aren't connected yet meet, and a large group of copies costs
one more pass over its rows rather than a pass for each of its blocks.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.operators.components import connected_components
from folioquery.plans.workspace import Workspace

#: Values of a sketch.
K = 24
SHINGLE = 5
PERCENT = 85
#: Members of a list, and shingles of a cluster, that one task compares with each other.
LIST_BLOCK, SET_BLOCK = 4096, 2_000_000
_PAD = np.iinfo(np.int64).max
_MEMO = 200_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = h
        return h


_words = _WordHash()
_ODD = np.array([int.from_bytes(hashlib.blake2b(b"%d" % i, digest_size=8).digest(), "little") | 1 for i in range(64)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``size`` consecutive words, A-Z lower-cased.

    Words are runs without ASCII white space. A text of fewer words is one shingle, one
    without words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    m = min(n, size)
    out = np.full(n - m + 1, m, np.uint64)
    for j in range(m):
        out += h[j : n - m + 1 + j] * _ODD[j % 64]
    return np.unique(mix(out).view(np.int64))


def needed(k: int, percent: int = PERCENT, risk: float = 1e-9) -> int:
    """Most common values that k draws reach but for ``risk`` at the threshold; at least 1."""
    p, below, c = percent / 100, 0.0, 0
    while c <= k:
        below += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > risk:
            break
        c += 1
    return max(c, 1)


def _components(n: np.ndarray, percent: int, common) -> list[list[int]]:
    """Components of two or more of the graph over members sorted by set size n.
    common(i, members) says which of them are linked to i. Members that are reached
    aren't compared again."""
    left, found = np.ones(len(n), bool), []
    low = np.searchsorted(n * 100, n * percent, "left")
    high = np.searchsorted(n * percent, n * 100, "right")
    for root in range(len(n)):
        if not left[root]:
            continue
        left[root], queue, whole = False, [root], [root]
        while queue:
            i = queue.pop()
            some = np.flatnonzero(left[low[i] : high[i]]) + low[i]
            if len(some):
                got = some[common(i, some)]
                left[got] = False
                queue += got.tolist()
                whole += got.tolist()
        if len(whole) > 1:
            found.append(whole)
    return found


def star(ids) -> list[tuple]:
    """Edges from the smallest id to the others."""
    low = min(ids)
    return [(low, x) for x in ids if x != low]


def _similar(percent: int, k: int):
    """Test of pairs by union sketch: (set sizes, sketches) of one side and the other."""
    need = np.array([needed(x, percent) if x else 1 for x in range(k + 1)])

    def test(n, sketch, m, other):
        both = np.sort(np.concatenate([sketch, other], 1), 1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
        new = np.ones(both.shape, bool)
        new[:, 1:] = ~twice
        rank = np.cumsum(new, 1)
        shared = (twice & (rank[:, 1:] <= k)).sum(1)
        size = np.minimum(k, (new & (both != _PAD)).sum(1))
        exact = (n <= k) & (m <= k)  # the sketches are the sets
        common = twice.sum(1)
        near = np.where(exact, 100 * common >= percent * (n + m - common), shared >= need[size])
        return near & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))

    return test


def _list_edges(ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int, test) -> list[tuple[int, int]]:
    order = np.argsort(n, kind="stable")
    ids, n, sketch = ids[order], n[order], sketch[order]
    found = _components(n, percent, lambda i, some: test(n[some], sketch[some], n[i], np.broadcast_to(sketch[i], (len(some), sketch.shape[1]))))
    return [e for whole in found for e in star(ids[whole].tolist())]


def small_pairs(at: np.ndarray, most: int):
    """Row pairs of groups of 2 to ``most`` rows; at: starts of the groups and the end."""
    size = np.diff(at)
    left = np.repeat(np.where(size <= most, at[1:], 0), size)  # end of the row's group, if it is small
    rows = np.arange(at[-1])
    for d in range(1, most):
        a = rows[rows + d < left]
        if len(a):
            yield a, a + d


def _exact_edges(ids: list, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    mask = np.zeros(int(flat.max()) + 1, bool)

    def common(i, some):
        own = flat[ends[i] - n[i] : ends[i]]
        mask[own] = True
        a, b = some[0], some[-1]  # a run of members by size
        base = ends[a] - n[a]
        hit = np.add.reduceat(mask[flat[base : ends[b]]], (ends[a : b + 1] - n[a : b + 1]) - base, dtype=np.int64)[some - a]
        mask[own] = False
        return 100 * hit >= percent * (n[some] + n[i] - hit)

    return [e for whole in _components(n, percent, common) for e in star([ids[i] for i in whole])]


def _edges(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], ["a", "b"])


def split(count, block: int):
    """Number of blocks of a group of ``count``."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(block))).cast("int")


def linked(rows: DataFrame, sizes: DataFrame, key: list[str], node: str, cols: list[str], compare, ws: Workspace, name: str) -> DataFrame:
    """Edges (a, b) whose components are those of all linked pairs within the groups ``key``.

    rows: key, node (binary), ``blocks`` (of the row's group) and what else ``cols`` name;
    sizes: a written table of key and blocks.
    compare: for mapInArrow, takes columns key, p and cols, sorted by key and p, gives edges
    within each (key, p). A group of one block is compared whole. In a larger one, each
    block is compared by itself; then, by the components that all groups have given so far,
    rows of the group's largest component stay in their block and all others go to every
    block: of two rows in different components at least one does, so the pair meets.
    """
    own = F.pmod(F.xxhash64(F.lit(7), node), F.col("blocks")).cast("int")

    def compared(df: DataFrame, step: str) -> DataFrame:
        dealt = df.select(*key, "p", *cols).repartition(*key, "p").sortWithinPartitions(*key, "p")
        return ws.table(dealt.mapInArrow(compare, "a binary, b binary"), step)

    first = compared(rows.withColumn("p", own), name)
    if not sizes.where("blocks > 1").limit(1).count():
        return first
    hot = rows.where("blocks > 1")
    at = connected_components(first, ws).select(F.col("node").alias(node), F.col("component").alias("_c"))
    hot = hot.join(at, node, "left").withColumn("_c", F.coalesce("_c", node))
    largest = hot.groupBy(*key, "_c").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max_by("_c", F.struct("n", "_c")).alias("_most"))
    again = hot.join(largest, key).withColumn("p", F.explode(F.when(F.col("_c") == F.col("_most"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return first.union(compared(again, name + "-rest"))


def _grouped(docs: DataFrame, ws: Workspace, text: str, percent: int, k: int, size: int, list_block: int, set_block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, copies, found). rows: doc_id, own (MD5 of the text), n, sig (name of the
    set, null if it is empty), sketch; copies: sig of sets that several rows have, rep
    (their smallest id); found: node (sig of a set linked to others), component."""

    def sketches(batches):
        for b in batches:
            n, sig, low, own = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                own.append(None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).digest())
                low.append(s[:k])
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low) if low else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), flat], ["doc_id", "own", "n", "sig", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    held = ws.table(rows.mapInArrow(sketches, "doc_id long, own binary, n long, sig binary, sketch array<bigint>"), "sketches")
    copies = held.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("own").alias("text"), F.count("*").alias("c"))
    copies = ws.table(copies.where("c > 1").select("sig", "rep", "text"), "copies")
    once = held.where("sig is not null").join(copies, "sig", "left")
    several = once.where("text is not null and doc_id <=> rep").dropDuplicates(["sig"])
    reps = once.where("text is null").select("sig", "n", "sketch").union(several.select("sig", "n", "sketch"))
    spare = F.get(F.array(*[F.lit(max(0, needed(x, percent) - 1)) for x in range(k + 1)]), F.least("n", F.lit(k)).cast("int"))
    posted = reps.select("sig", F.explode("sketch").alias("value"))
    shared = posted.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    rare = posted.join(shared, "value").groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("v"))  # k values at most
    rare = rare.join(reps.select("sig", spare.alias("spare")), "sig").where(F.size("v") > F.col("spare")).select("sig", F.explode(F.slice("v", F.lit(1), F.size("v") - F.col("spare"))).alias("v"))
    listed = ws.table(rare.select("sig", "v.value"), "listed")
    live = listed.groupBy("value").agg(F.count("*").alias("c")).where("c > 1").select("value", split(F.col("c"), list_block).alias("blocks"))
    live = ws.table(live, "live")
    members = listed.join(live, "value").join(reps, "sig")

    def from_lists(batches):
        rest = None
        for b in batches:
            part = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            flat, ends = b.column(4).flatten().to_numpy(), np.cumsum([0, *b.column(4).value_lengths().to_pylist()])
            sk = np.full((len(part[0]), k), _PAD, np.int64)
            lens = np.diff(ends)
            sk[np.arange(k)[None, :] < lens[:, None]] = flat
            now = [*part, sk]
            rest = now if rest is None else [np.concatenate([x, y]) for x, y in zip(rest, now)]
            key = np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])) + 1
            if len(key):
                yield from run(rest, [0, *key.tolist()])
                rest = [x[key[-1] :] for x in rest]
        if rest is not None and len(rest[0]):
            yield from run(rest, [0, len(rest[0])])

    test = _similar(percent, k)

    def run(c, at):
        out, at = [], np.array(at)
        for a, b in small_pairs(at, 8):
            ok = test(c[3][a], c[4][a], c[3][b], c[4][b])
            out += zip(c[2][a[ok]].tolist(), c[2][b[ok]].tolist())
        for g in np.flatnonzero(np.diff(at) > 8).tolist():
            z = slice(at[g], at[g + 1])
            out += _list_edges(c[2][z], c[3][z], c[4][z], percent, test)
        if out:
            yield _edges(out)

    near = linked(members, live, ["value"], "sig", ["sig", "n", "sketch"], from_lists, ws, "near")
    clusters = ws.table(connected_components(near, ws), "clusters")

    def full_sets(batches):
        for b in batches:
            sets = [shingles(t, size) for t in b.column(0).to_pylist()]
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            right = [x == y for x, y in zip(sig, b.column(1).to_pylist())]  # rows that share an id may have other texts
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "cluster", "blocks", "set"]).filter(pa.array(right, pa.bool_()))

    in_cluster = clusters.select(F.col("node").alias("sig"), F.col("component").alias("cluster"))
    weight = in_cluster.join(reps.select("sig", "n"), "sig").groupBy("cluster").agg(split(F.sum("n"), set_block).alias("blocks"))
    # each set is made anew from the text of one of its rows
    weight = ws.table(weight, "weight")
    of_row = in_cluster.join(weight, "cluster").join(held.select("sig", "doc_id", "own"), "sig").groupBy("sig", "cluster", "blocks").agg(F.min(F.struct("own", "doc_id")).alias("r"))
    of_row = of_row.select("sig", "cluster", "blocks", F.col("r.doc_id").alias("_id"), F.col("r.own").alias("_own"))
    texts = rows.withColumn("_md5", F.unhex(F.md5(text)))
    of_text = texts.hint("merge").join(of_row, (texts["doc_id"].eqNullSafe(of_row["_id"])) & (F.col("_md5") == F.col("_own")))
    sets = of_text.select(text, "sig", "cluster", "blocks").mapInArrow(full_sets, "sig binary, cluster binary, blocks int, set binary")

    if held.join(copies, "sig").groupBy("doc_id", "own").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["sig"])

    def verify(batches):
        at, ids, got = None, [], []
        for b in batches:
            for c, p, d, s in zip(*(b.column(i).to_pylist() for i in range(4))):
                if at != (c, p):
                    if len(ids) > 1:
                        yield _edges(_exact_edges(ids, got, percent))
                    at, ids, got = (c, p), [], []
                ids.append(d)
                got.append(np.frombuffer(s, np.int64))
        if len(ids) > 1:
            yield _edges(_exact_edges(ids, got, percent))

    links = linked(ws.table(sets, "sets"), weight, ["cluster"], "sig", ["sig", "set"], verify, ws, "links")
    return held, copies, ws.table(connected_components(links, ws), "components")


def cluster(docs: DataFrame, text: str = "text", percent: int = PERCENT, k: int = K, size: int = SHINGLE, list_block: int = LIST_BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; doc_id is long.

    Texts are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable. Null, empty and blank texts have no
    shingles and no links. Rows with the same id are linked each by its own text. A row
    without an id links texts like any other; its component_id is null only if no row
    of its component has an id, and then it is kept.
    """
    held, copies, found = _grouped(docs, Workspace(docs.sparkSession, "near-dup"), text, percent, k, size, list_block, set_block)
    of_set = found.withColumnRenamed("node", "sig")
    low = held.select("sig", "doc_id").join(of_set, "sig").groupBy("component").agg(F.min("doc_id").alias("low"))
    out = held.select("doc_id", "n", "sig").join(copies.select("sig", "rep"), "sig", "left").join(of_set.join(low, "component").select("sig", "low"), "sig", "left")
    out = out.withColumn("component_id", F.coalesce("low", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def near_dup_query(docs: DataFrame) -> DataFrame:
    """``cluster`` at a similarity of 0.85, with its rules for nulls, repeats and empty texts."""
    return cluster(docs)


def drop_near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT, **more) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of smallest id; of rows with
    this id that of the smallest text digest; of such rows with equal texts any one.

    Rows are told apart by id and text, so rows that share an id, or have none, all stay
    unless their texts are near copies. An id counts before no id. Texts without words stay.
    """
    ws = Workspace(docs.sparkSession, "near-dedup")
    sizes = {"k": K, "size": SHINGLE, "list_block": LIST_BLOCK, "set_block": SET_BLOCK} | more
    held, copies, found = _grouped(docs, ws, text, percent, **sizes)
    groups = found.withColumnRenamed("node", "sig")
    several = held.select("doc_id", "own", "sig").join(copies.select("sig").union(groups.select("sig")).distinct(), "sig")
    several = several.groupBy("sig", "doc_id", "own").agg(F.count("*").alias("c")).join(groups, "sig", "left").withColumn("group", F.coalesce("component", "sig"))
    several = ws.table(several.select("group", "doc_id", "own", "c"), "several")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "own")
    first = several.groupBy("group").agg(F.min(order).alias("first"))
    judged = several.join(first, "group").select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"), (order != F.col("first")).alias("_gone"), (F.col("c") > 1).alias("_twice"))
    judged = ws.table(judged.where("_gone or _twice"), "judged")
    cols = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_d"), F.unhex(F.md5(text)).alias("_m"))
    marked = rows.join(judged, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_own")), "left").where("_gone is null or not _gone")
    if not judged.where("_twice and not _gone").limit(1).count():
        return marked.select(*cols)
    return marked.where("_own is null").select(*cols).union(marked.where("_own is not null").dropDuplicates(["_d", "_m"]).select(*cols))
