"""How far two sets of boxes cover the same area: a line sweeps over each group's boxes from left to
right, and knows which heights either set covers. Work and memory grow with the number of boxes of a
group, not with their area."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def swept(side, x0, y0, x1, y1) -> tuple[float, float, float]:
    """(area of side 0, of side 1, of what both cover) of boxes, each area once however many boxes
    cover it. Boxes without area count for nothing."""
    side, x0, y0, x1, y1 = (np.asarray(v) for v in (side, x0, y0, x1, y1))
    real = (x1 > x0) & (y1 > y0)
    side, x0, y0, x1, y1 = side[real], x0[real], y0[real], x1[real], y1[real]
    heights = np.unique(np.concatenate([y0, y1]))
    if not len(heights):
        return 0.0, 0.0, 0.0
    tall, low, high = np.diff(heights), np.searchsorted(heights, y0), np.searchsorted(heights, y1)
    at = np.concatenate([x0, x1])
    order = np.argsort(at, kind="stable")
    cover, areas, last = np.zeros((2, len(tall)), np.int64), np.zeros(3), at[order[0]]
    n = len(x0)
    for e in order.tolist():
        if at[e] > last:
            held = cover > 0
            areas += (at[e] - last) * np.array([tall[held[0]].sum(), tall[held[1]].sum(), tall[held[0] & held[1]].sum()])
            last = at[e]
        i = e % n
        cover[side[i], low[i] : high[i]] += 1 if e < n else -1
    return tuple(float(a) for a in areas)


#: Groups of so many boxes are covered many at a time, larger ones are swept one by one.
FEW = 16


def swept_many(side, x0, y0, x1, y1) -> np.ndarray:
    """swept() of each of many groups, given as lists of arrays: a row (area 0, area 1, common) a group.

    Groups of equally many boxes lie in one array; their edges cut the plane into cells, and each cell is
    held by a box or not. Cells grow with the square of a group's boxes, hence only up to FEW."""
    size = np.array([len(s) for s in side], np.int64)
    out = np.zeros((len(size), 3))
    for m in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == m)
        if m <= FEW:
            s, a, b, c, d = (np.array([v[i] for i in at], float) for v in (side, x0, y0, x1, y1))
            plain = np.isfinite(a + b + c + d).all(1)
            s, a, b, c, d = (v[plain] for v in (s, a, b, c, d))
            out[at[plain]] = _covered(s, a, b, c, d)
            at = at[~plain]
        for i in at:
            out[i] = swept(side[i], x0[i], y0[i], x1[i], y1[i])
    return out


def _covered(side, x0, y0, x1, y1) -> np.ndarray:
    """swept() of groups of m boxes, arrays of a row a group."""
    x, y = np.sort(np.concatenate([x0, x1], 1), 1), np.sort(np.concatenate([y0, y1], 1), 1)
    wide, tall = np.diff(x), np.diff(y)
    held = np.zeros((2, len(side), wide.shape[1], tall.shape[1]), bool)
    real = (x1 > x0) & (y1 > y0)
    for k in range(side.shape[1]):
        across = (x0[:, k, None] <= x[:, :-1]) & (x1[:, k, None] >= x[:, 1:]) & real[:, k, None]
        down = (y0[:, k, None] <= y[:, :-1]) & (y1[:, k, None] >= y[:, 1:])
        for s in (0, 1):
            held[s] |= (across & (side[:, k, None] == s))[:, :, None] & down[:, None, :]
    area = lambda cells: ((cells * tall[:, None, :]).sum(2) * wide).sum(1)
    return np.stack([area(held[0]), area(held[1]), area(held[0] & held[1])], 1)


def on_grid(low: Column, high: Column, cell: float) -> tuple[Column, Column]:
    """First cell of a stretch, and the one after its last; the cell that the end lies in is covered."""
    return F.floor(low / cell), F.floor(high / cell) + 1


def overlap_areas(boxes: DataFrame, keys: list[str], cell: float | None = 4.0) -> DataFrame:
    """(keys, n_a, n_b, common, iou) of the boxes of side 0 and side 1 of each key, in cells of a grid of
    ``cell``, or as real areas without one. boxes: keys, side, x0, y0, x1, y1; null boxes count for
    nothing. iou is null where nothing is covered. A group's boxes lie in one task.
    """
    import pandas as pd

    (x0, x1), (y0, y1) = (on_grid(F.col(a), F.col(b), cell) if cell else (F.col(a), F.col(b)) for a, b in (("x0", "x1"), ("y0", "y1")))
    names = ["x0", "y0", "x1", "y1"]
    cells = boxes.select(*keys, "side", *[c.cast("double").alias(n) for n, c in zip(names, (x0, y0, x1, y1))]).dropna(subset=names)
    listed = cells.groupBy(*keys).agg(F.collect_list(F.struct("side", *names)).alias("_boxes"))
    listed = listed.select(*keys, *[F.col("_boxes")[n].alias(n) for n in ["side", *names]])

    def areas(side: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(swept_many(*(v.tolist() for v in (side, x0, y0, x1, y1))), columns=["n_a", "n_b", "common"])

    kind = "bigint" if cell else "double"
    out = listed.select(*keys, F.pandas_udf(areas, "n_a double, n_b double, common double")("side", *names).alias("r"))
    iou = F.round(F.try_divide(F.col("r.common"), F.col("r.n_a") + F.col("r.n_b") - F.col("r.common")), 6)
    return out.select(*keys, *[F.col(f"r.{c}").cast(kind).alias(c) for c in ("n_a", "n_b", "common")], iou.alias("iou"))


def localisation(gold: DataFrame, pred: DataFrame, boxes: DataFrame, doc: str, cell: float = 4.0) -> DataFrame:
    """(doc, node, gold, pred, exact, iou) of every node of the gold: numbers of gold and predicted boxes
    (0: absent, not found), whether they are the same boxes, and how far their areas agree over all pages
    (1 if exact, 0 without boxes on both sides), as cards.node_card() takes them.

    gold: doc, node, box, with a null box for an absent node; pred: doc, node, box; boxes: doc, box, page,
    x0, y0, x1, y1. Repeated rows count once, predictions for other nodes aren't looked at, boxes
    without geometry cover nothing. Only nodes that aren't exact are swept.
    """
    nodes = gold.select(doc, "node").distinct()
    sides = gold.select(doc, "node", "box", F.lit(0).alias("side")).union(pred.select(doc, "node", "box", F.lit(1)).join(nodes, [doc, "node"], "left_semi"))
    each = sides.groupBy(doc, "node", "box").agg(F.max(F.col("side") == 0).alias("a"), F.max(F.col("side") == 1).alias("b"))
    each = each.withColumns({"a": F.col("a") & F.col("box").isNotNull(), "b": F.col("b") & F.col("box").isNotNull()})
    counted = each.groupBy(doc, "node").agg(F.count_if("a").alias("gold"), F.count_if("b").alias("pred"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    counted = counted.withColumn("exact", (F.col("both") == F.col("gold")) & (F.col("both") == F.col("pred")) & (F.col("both") > 0))
    some = counted.where("not exact and gold > 0 and pred > 0").select(doc, "node")
    placed = each.join(some, [doc, "node"], "left_semi").join(boxes, [doc, "box"])
    flat = placed.select(doc, "node", "page", F.explode(F.filter(F.array(F.when(F.col("a"), 0), F.when(F.col("b"), 1)), lambda s: s.isNotNull())).alias("side"), "x0", "y0", "x1", "y1")
    areas = overlap_areas(flat, [doc, "node", "page"], cell).groupBy(doc, "node")
    areas = areas.agg(F.try_divide(F.sum("common"), F.sum(F.col("n_a") + F.col("n_b") - F.col("common"))).alias("iou"))
    iou = F.when(F.col("exact"), 1.0).otherwise(F.coalesce("iou", F.lit(0.0)))
    return counted.join(areas, [doc, "node"], "left").select(doc, "node", "gold", "pred", "exact", F.round(iou, 6).alias("iou"))
