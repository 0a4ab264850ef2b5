"""Which page boxes render which passage: theta, similarity and lexical joins within a
document, the owner of a box, and the closure over a tree."""

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions.text import norm_alnum, words_of
from folioquery.functions.vectors import char_grams, dot, tfidf
from folioquery.operators.folds import walked
from folioquery.plans.workspace import Workspace


def naive_score(a: Column, b: Column, a_words: Column, b_words: Column) -> Column:
    """1 if one text holds the other, else common words over the smaller word set."""
    few = F.least(F.size(a_words), F.size(b_words))
    return F.when(a.contains(b) | b.contains(a), 1.0).when(few == 0, 0.0).otherwise(F.size(F.array_intersect(a_words, b_words)) / few)


#: Most postings of words that are counted at once; a document's pairs are scored in blocks of boxes.
BLOCK = 2_000_000


def naive_pairs(segs: list[str], boxes: list[str], threshold: float, top: int | None = None) -> list[tuple[int, int, float]]:
    """(box, seg, score) of naive_score() at or over the threshold, by place in the two lists. With ``top``
    only the best that many of each box and the best of each passage, the first of equal ones.

    Words in common are counted from lists of the passages that hold a word. A text in another one
    has all its words there but the first and the last, so only such pairs are compared as texts.
    """
    words = {}
    for i, t in enumerate(segs):
        for w in set(t.split(" ")) if t else ():
            words.setdefault(w, []).append(i)
    words = {w: np.array(at, np.int64) for w, at in words.items()}
    n_seg = np.array([len(set(t.split(" "))) if t else 0 for t in segs], np.int64)
    sets = [set(t.split(" ")) if t else set() for t in boxes]
    best, best_box, out, k, n = np.full(len(segs), -1.0), np.zeros(len(segs), np.int64), [], 0, len(segs)
    while k < len(boxes):
        first, room, lists = k, BLOCK, []
        while k < len(boxes) and (k == first or room > 0):
            met = [at for w in sets[k] if (at := words.get(w)) is not None]
            if met:
                lists.append(np.concatenate(met) + (k - first) * n)
                room -= len(lists[-1])
            room -= n
            k += 1
        common = np.bincount(np.concatenate(lists), minlength=(k - first) * n) if lists else np.zeros((k - first) * n, np.int64)
        common = common.reshape(k - first, n)
        n_box = np.array([len(s) for s in sets[first:k]], np.int64)[:, None]
        few = np.minimum(n_box, n_seg)
        score = np.divide(common, few, out=np.zeros(common.shape), where=few > 0)
        i, j = np.nonzero((score < 1) & ((common >= n_box - 2) | (common >= n_seg - 2)))
        inside = np.array([segs[y] in (b := boxes[x]) or b in segs[y] for x, y in zip((i + first).tolist(), j.tolist())], bool)
        score[i[inside], j[inside]] = 1.0
        if top is None:
            i, j = np.nonzero(score >= threshold)
            out += zip((i + first).tolist(), j.tolist(), score[i, j].tolist())
            continue
        i = score.argmax(0)
        more = score[i, np.arange(n)] > best
        best[more], best_box[more] = score[i, np.arange(n)][more], i[more] + first
        for _ in range(min(top, n)):
            j = score.argmax(1)
            i = np.flatnonzero(score[np.arange(k - first), j] >= threshold)
            out += zip((i + first).tolist(), j[i].tolist(), score[i, j[i]].tolist())
            score[i, j[i]] = -1.0
    if top is not None:
        held = {(i, j) for i, j, _ in out}
        out += [(i, j, s) for j, (i, s) in enumerate(zip(best_box.tolist(), best.tolist())) if s >= threshold and (i, j) not in held]
    return out


def align_naive(segs: DataFrame, boxes: DataFrame, threshold: float = 0.5, top: int | None = None) -> DataFrame:
    """(doc_id, seg, gold, box, score) of pairs at or over the threshold; with ``top`` only those among the
    ``top`` best of their box, score down, then passage order, and the best of each passage.

    segs: doc_id, seg, norm; boxes: doc_id, gold, box, text. A document is one group, see naive_pairs().
    """
    rows = segs.where("norm is not null").select("doc_id", F.lit(0).alias("side"), F.col("seg").alias("key"), F.lit(None).cast(dict(boxes.dtypes)["gold"]).alias("gold"), F.col("norm").alias("t"))
    bn = boxes.select("doc_id", F.lit(1), F.col("box"), F.col("gold"), norm_alnum(F.col("text")).alias("t")).where("t <> ''")
    kinds = dict(segs.dtypes) | dict(boxes.dtypes)

    def one(rows: list[dict]):
        cut = next((i for i, r in enumerate(rows) if r["side"]), len(rows))
        a, b = rows[:cut], rows[cut:]
        for i, j, score in naive_pairs([r["t"] for r in a], [r["t"] for r in b], threshold, top):
            yield rows[0]["doc_id"], a[j]["key"], b[i]["gold"], b[i]["key"], score

    schema = f"doc_id {kinds['doc_id']}, seg {kinds['seg']}, gold {kinds['gold']}, box {kinds['box']}, score double"
    return walked(rows.union(bn).where("doc_id is not null"), ["doc_id"], ["side", "gold", "key"], one, schema)


def owners(aligned: DataFrame, box_keys: list[str], top: int = 1) -> DataFrame:
    """The ``top`` best passages of each box: score down, then passage order; column rank."""
    order = W.partitionBy(*box_keys).orderBy(F.desc("score"), "seg")
    return aligned.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


#: Most vectors of one part of a block, and rows of it that are compared at once.
PART, TILE = 4_096, 512


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of every two rows, rounded to 4 places as Spark rounds the sum taken in order: sums that
    lie so near to a tie that their order may matter are taken again in order."""
    from decimal import ROUND_HALF_UP, Decimal

    with np.errstate(all="ignore"):
        s = a @ b.T
        length = np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0))
        out, scaled = np.round(s, 4), np.abs(s) * 1e4
        i, j = np.nonzero(~(np.abs(scaled - np.floor(scaled) - 0.5) > 1e-8 * max(1.0, length)) & np.isfinite(s))
        if len(i):
            each = np.zeros(len(i))
            for k in range(a.shape[1]):
                each += a[i, k] * b[j, k]
            out[i, j] = [float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for x in each.tolist()]
    return out


def align_vectors(nodes: DataFrame, boxes: DataFrame, block: str, floor: float = 0.2) -> DataFrame:
    """(block, node, box, score): cosine of unit vectors within a block, rounded to 4 places, at or over ``floor``.

    nodes: block, node, vec; boxes: block, box, vec2; vectors with a null, or of unlike lengths, don't
    meet. Both sides of a block are dealt into parts of about PART rows, and every two parts are a
    task's group: its vectors are held, its scores are made a tile at a time.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = dict(nodes.dtypes) | dict(boxes.dtypes)
    vector = lambda c: F.transform(c, lambda x: x.cast("double"))
    whole = lambda c: F.col(block).isNotNull() & F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    a = nodes.where(whole("vec")).select(block, "node", vector("vec").alias("v"), F.size("vec").alias("_d"))
    b = boxes.where(whole("vec2")).select(block, "box", vector("vec2").alias("v"), F.size("vec2").alias("_d"))
    keys, place = [block, "_d"], [block, "_d", "_i", "_j"]
    parts = lambda rows, n: rows.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias(n))
    parted = parts(a, "_n").join(parts(b, "_m"), keys)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = a.join(parted, keys).select(*keys, own("node", "_n").alias("_i"), every("_m").alias("_j"), F.lit(0).alias("_side"), "node", F.lit(None).cast(kinds["box"]).alias("box"), "v")
    right = b.join(parted, keys).select(*keys, every("_n").alias("_i"), own("box", "_m").alias("_j"), F.lit(1), F.lit(None).cast(kinds["node"]), "box", "v")
    schema = f"{block} {kinds[block]}, node {kinds['node']}, box {kinds['box']}, score double"
    arrow = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {0: [], 1: []}
        for batch in batches:
            side, v = batch.column("_side").to_numpy(), batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            for s, name in ((0, "node"), (1, "box")):
                at = np.flatnonzero(side == s)
                if len(at):
                    held[s].append((flat[at], batch.column(name).take(pa.array(at))))
        if not (held[0] and held[1]):
            return
        (a, node), (b, box) = ((np.concatenate([x for x, _ in h]), pa.concat_arrays([x for _, x in h])) for h in (held[0], held[1]))
        for at in range(0, len(a), TILE):
            score = _cosines(a[at : at + TILE], b)
            i, j = np.nonzero(~(score < floor))
            for k in range(0, len(i), 100_000):
                x, y = i[k : k + 100_000], j[k : k + 100_000]
                named = pa.repeat(key[0], len(x)).cast(arrow.field(0).type)
                yield pa.RecordBatch.from_arrays([named, node.take(pa.array(x + at)), box.take(pa.array(y)), pa.array(score[x, y])], schema=arrow)

    return left.union(right).groupBy(*place).applyInArrow(meet, schema)


def align_lexical(nodes: DataFrame, boxes: DataFrame, total: int, least: int = 3, most: int = 5) -> DataFrame:
    """(seg, box, score): cosine of character n-gram TF-IDF over both sides' texts.

    nodes: seg, text; boxes: box, text; total: number of texts. Only pairs that share a
    gram meet, by a join on grams.
    """
    both = nodes.select(F.lit(0).alias("side"), F.col("seg").alias("key"), "text").union(boxes.select(F.lit(1), "box", "text"))
    grams = both.select("side", "key", char_grams(norm_alnum(F.col("text")), least, most).alias("g"))
    w = tfidf(grams, ["side", "key"], "g", total)
    left = w.where("side = 0").select(F.col("key").alias("seg"), "gram", "weight")
    right = w.where("side = 1").select(F.col("key").alias("box"), "gram", F.col("weight").alias("weight2"))
    return left.join(right, "gram").groupBy("seg", "box").agg(F.sum(F.col("weight") * F.col("weight2")).alias("score"))


def coverage(segs: DataFrame, aligned: DataFrame, by: str) -> DataFrame:
    """(by, n, covered, coverage): share of passages with a box."""
    hit = aligned.select("doc_id", "seg").distinct().withColumn("hit", F.lit(1))
    joined = segs.join(hit, ["doc_id", "seg"], "left")
    return joined.groupBy(by).agg(F.count("*").alias("n"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))


_first = itemgetter(0, 1)


def _monotone(boxes: list, ratio: float, few: int | None, need: int) -> tuple[int, list[tuple[int, int]]]:
    """best_monotone(), knowing that ``need`` can be gained: what can't come to that much with the best candidates of all
    boxes to come is left out. With ``few`` only so many uses of a passage are kept, which gives some gain, not the best."""
    order = sorted({c[0] for _, cs in boxes for c in cs})
    at, n = {s: i for i, s in enumerate(order)}, len(order)
    front: list[list[tuple[int, int, tuple | None]]] = [[] for _ in order]  # (used, -gain, chain)
    tree: list[tuple[int, int, tuple | None]] = [(0, 0, None)] * (n + 1)  # (-gain, passage, chain), as gains only grow
    most = sum(max((c[3] for c in cs), default=0) for _, cs in boxes) - need  # -gain of a state may be up to this
    for box, cands in boxes:
        new = []
        most -= max((c[3] for c in cands), default=0)
        for seg, size, room, gain in cands:
            i, cap = at[seg], int(ratio * room)
            if size <= cap:
                (g, s, chain), k = tree[0], i
                while k:
                    t, k = tree[k], k & (k - 1)
                    if t[0] < g or t[0] == g and t[1] < s:
                        g, s, chain = t
                more = [(size, g - gain, (chain, box, seg))] if g - gain <= most else []
                if front[i]:
                    more += [(u + size, g - gain, (c, box, seg)) for u, g, c in front[i] if u + size <= cap and g - gain <= most]
                if more:
                    new.append((i, more))
        for i, more in new:
            kept, least, was = [], 1, front[i]
            for state in sorted([x for x in was if x[1] <= most] + more, key=_first) if was else more:
                if state[1] < least:
                    kept.append(state)
                    least = state[1]
            if few and len(kept) > few:
                kept = kept[-few:]
            front[i], best, k = kept, (least, i, kept[-1][2]), i + 1
            if was and was[-1] is kept[-1]:
                continue
            while k <= n:
                t = tree[k]
                if t[0] < least or t[0] == least and t[1] < i:
                    break  # so it is in all wider ones
                tree[k], k = best, k + (k & -k)
    gain, chain = min([(f[-1][1], f[-1][2]) for f in front if f] + [(0, None)], key=lambda x: x[0])
    out = []
    while chain:
        chain, box, seg = chain
        out.append((box, seg))
    return -gain, out[::-1]


#: From so many candidates on, some gain is sought first, see _monotone().
SOUGHT = 200


def best_monotone(boxes: list[tuple[int, list[tuple[int, int, int, int]]]], ratio: float) -> tuple[int, list[tuple[int, int]]]:
    """(gain, [(box, seg)]) for boxes in reading order with candidates (seg, box size, passage
    size, gain): passages never go back, and one takes at most ``ratio`` times its size.

    A passage's boxes are one run, so for each passage it is enough to keep the best gain by
    characters used (more use only for more gain), and before a box the best of all earlier
    passages, which a tree of maxima over the passages gives. A gain that is reached anyway, found first,
    rules out what lies too far behind it; no candidate and no state that can be best is left out.
    """
    need = _monotone(boxes, ratio, 2, 0)[0] if sum(len(cs) for _, cs in boxes) >= SOUGHT else 0
    return _monotone(boxes, ratio, None, need)


def monotone_owners(boxes: list[tuple[int, int, list[tuple[int, int, float]]]], threshold: float = 0.5, ratio: float = 2.0) -> list[tuple[int, int]]:
    """(box, seg) by best_monotone(), all candidates counted. boxes, in reading order: (box, size, [(seg, passage size, score)]).
    A pair's gain is its score over the threshold in ten-thousandths, plus one so that a pair at the threshold is better than none."""
    return best_monotone([(b, [(s, size, room, int(round((score - threshold) * 10_000)) + 1) for s, room, score in cs]) for b, size, cs in boxes], ratio)[1]


def monotone_assignment(scored: DataFrame, threshold: float = 0.5, ratio: float = 2.0) -> DataFrame:
    """(doc_id, box, seg): owners of largest total gain, see monotone_owners(), over all pairs at or over the threshold.

    scored: doc_id, seg, seg_chars, box, box_chars, score. A document's pairs are one group.
    """

    def one(rows: list[dict]):
        boxes: dict = {}
        for r in rows:
            boxes.setdefault(r["box"], (r["box"], r["box_chars"], []))[2].append((r["seg"], r["seg_chars"], r["score"]))
        return [(rows[0]["doc_id"], b, s) for b, s in monotone_owners(list(boxes.values()), threshold, ratio)]

    best = scored.where(F.col("score") >= threshold).select("doc_id", "seg", "seg_chars", "box", "box_chars", "score")
    return walked(best, ["doc_id"], ["box", "seg"], one, "doc_id long, box long, seg long")


def closure(edges: DataFrame, levels: int = 100) -> DataFrame:
    """(ancestor, node, depth) of parent-child edges, each node its own ancestor at 0.

    One join a level, each level a written table, until one is empty; edges without a child end a
    branch. Trees deeper than ``levels`` and cycles are an error.
    """
    ws = Workspace(edges.sparkSession, "closure")
    links = ws.table(edges.where("parent is not null and child is not null").select("parent", "child"), "links")
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).where("node is not null").distinct()
    level = ws.table(nodes.select(F.col("node").alias("ancestor"), "node", F.lit(0).cast("long").alias("depth")), "level")
    out = level
    for depth in range(1, levels + 2):
        below = level.join(links, level["node"] == links["parent"]).select("ancestor", F.col("child").alias("node"), F.lit(depth).cast("long").alias("depth"))
        level = ws.table(below, "level")
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError("the tree is deeper than allowed or has a cycle")
