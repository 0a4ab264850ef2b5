"""Key-value records: tables in text, grounding, collapsing, scoring, key vocabularies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions import views
from folioquery.functions.text import canon_value, clean_ws, norm_key
from folioquery.functions.vectors import dot

GROUNDING = ["in_evidence", "in_document", "evidence_only", "none"]


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text, start): lines with their offset in the text."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "text"))
    before = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def pipe_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, col, header, entity, value): cells of pipe tables with their column's header.

    A table is a header line, a separator line of dashes, and the lines with pipes that
    follow it without a break. The first cell names the row. Cells that are empty or a
    dash, columns without a header and cells beyond the header are left out; the entity is
    empty where it equals the value.
    """
    lines = text_lines(docs, key, text)
    order = W.partitionBy(key).orderBy("line")
    piped, rule = F.col("text").contains("|"), F.col("text").rlike(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$")
    lines = lines.withColumn("rule", rule & piped).withColumn("piped", piped)
    lines = lines.withColumn("head", F.lag("text").over(order)).withColumn("stop", F.when(~F.col("piped") | F.col("rule"), F.col("line")))
    last = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("at", F.last("stop", ignorenulls=True).over(last))
    heads = lines.where("rule and head like '%|%'").select(key, F.col("line").alias("at"), _cells(F.col("head")).alias("names"))
    body = lines.where("piped and not rule").join(heads, [key, "at"])
    cells = body.select(key, "line", "names", _cells(F.col("text")).alias("cells"))
    cells = cells.select(key, "line", "names", F.get("cells", F.lit(0)).alias("first"), F.posexplode("cells").alias("col", "value"))
    header = norm_key(F.get("names", F.col("col")))
    out = cells.select(key, "line", F.col("col").cast("long").alias("col"), header.alias("header"), F.when(F.col("first") != F.col("value"), F.col("first")).otherwise("").alias("entity"), "value")
    return out.where("header is not null and header <> '' and value not in ('', '-')")


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def ground(records: DataFrame, value: str, evidence: str, document: str) -> DataFrame:
    """records with ``grounded_by``, and ``start``, ``stop`` and ``said``, the span of the document's text.

    Texts are compared in their views (functions.views). The value is looked for inside the place
    of its evidence in the document, else in the document; if it is in neither, the evidence's own place
    stands for it (evidence_only), else nothing does (none; no span). Null and empty texts are nowhere.
    """
    rows = records.withColumn("_p", views.pieces(F.col(document))).withColumn("_d", views.shown(F.col("_p")))
    rows = rows.withColumn("_v", views.view(F.col(value))).withColumn("_e", views.view(F.col(evidence)))
    rows = rows.withColumn("_ea", views.find(F.col("_d"), F.col("_e")))
    inside = views.find(F.col("_d"), F.col("_v"), F.col("_ea"), F.col("_ea") + F.length("_e"))
    rows = rows.withColumn("_ia", inside).withColumn("_va", views.find(F.col("_d"), F.col("_v")))
    kind = F.when(F.col("_ia").isNotNull(), "in_evidence").when(F.col("_va").isNotNull(), "in_document").when(F.col("_ea").isNotNull(), "evidence_only").otherwise("none")
    at, size = F.coalesce("_ia", "_va", "_ea"), F.when(F.coalesce("_ia", "_va").isNotNull(), F.length("_v")).otherwise(F.length("_e"))
    rows = rows.withColumn("grounded_by", kind).withColumn("_s", views.source_span(F.col("_p"), at, size))
    said = F.substring(F.col(document), F.col("_s.start") + 1, F.col("_s.stop") - F.col("_s.start"))
    return rows.select(*[F.col(f"`{c}`") for c in records.columns], "grounded_by", "_s.start", "_s.stop", said.alias("said"))


def collapse(records: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One record for each key and canonical value: mentions, the strongest grounding, the
    value of the first record of highest confidence.

    records: keys, value, order, confidence (0 low to 2 high), grounding rank, at.
    """
    canon = records.withColumn("canon", canon_value(F.col(value)))
    return canon.groupBy(*keys, "canon").agg(
        F.min_by(value, F.struct(-F.col("confidence"), F.col(order))).alias(value),
        F.max("confidence").alias("confidence"),
        F.max("grounding").alias("grounding"),
        F.countDistinct("at").alias("mentions"),
    )


def match_levels(gold: DataFrame, pred: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Gold records with ``level``: the first of ``levels`` (lists of columns, strictest
    first) at which a prediction is left for them; null if none is.

    Within a level equal keys pair off by rank, so each record is used once.
    gold: id and columns; pred: id and columns.
    """
    out = None
    for n, cols in enumerate(levels, 1):
        rank = lambda df: df.withColumn("_r", F.row_number().over(W.partitionBy(*cols).orderBy("id")))
        got = rank(gold).select(F.col("id"), *cols, "_r").join(rank(pred).select(F.col("id").alias("pid"), *cols, "_r"), [*cols, "_r"]).select("id", "pid")
        level = got.select("id", "pid", F.lit(n).cast("long").alias("level"))
        out = level if out is None else out.union(level)
        gold = gold.join(got.select("id"), "id", "left_anti")
        pred = pred.join(got.select(F.col("pid").alias("id")), "id", "left_anti")
    return out


def field_states(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, field, state): hit if a found text holds the wanted value, partial if the value
    holds a found text of two characters or more, else miss; case and white space don't count.

    wanted: key, field, value; found: key, text.
    """
    near = found.select(key, F.lower(clean_ws(F.col("text"))).alias("_t")).distinct()
    v, t = F.lower("value"), F.col("_t")
    rank = F.max(F.when(t.contains(v), 2).when((F.length(t) > 1) & v.contains(t), 1).otherwise(0))
    got = wanted.join(near, key, "left").groupBy(key, "field").agg(F.coalesce(rank, F.lit(0)).alias("_r"))
    return got.select(key, "field", F.when(F.col("_r") == 2, "hit").when(F.col("_r") == 1, "partial").otherwise("miss").alias("state"))


def assign_vocabulary(vectors: DataFrame, centroids: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, label, score): the nearest centroid (first of equals) at or over ``threshold``
    of cosine, else the key itself. centroids are few and broadcast by size."""
    met = vectors.crossJoin(centroids).withColumn("score", F.round(dot(F.col("vec"), F.col("centroid")), 4))
    best = met.groupBy(key).agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), F.col("label"))).alias("b"))
    ok = F.col("b.score") >= threshold
    return best.select(key, F.when(ok, F.col("b.label").cast("string")).otherwise(F.concat(F.lit("self:"), F.col(key).cast("string"))).alias("label"), F.col("b.score").alias("score"))


def average_linkage(v: "np.ndarray", threshold: float, room: int = 4_000_000) -> list[int]:
    """For each row the first row of its cluster: average linkage by cosine distance up to ``threshold``.

    The mean distance of two clusters comes from their summed unit vectors, so no matrix of
    distances is held. In every round all pairs that are each other's nearest are joined, as no join brings
    a third cluster nearer than its nearest was; only clusters whose nearest is gone are compared
    anew, and those with nothing within the threshold are done. Equal vectors are joined beforehand.
    room: most distances that are held at once.
    """
    import numpy as np

    length = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.maximum(length, 1e-9)
    own = np.arange(len(v))
    if threshold >= 0 and len(v):
        _, first, same = np.unique(v, axis=0, return_index=True, return_inverse=True)
        own = np.where(length[:, 0] > 0, first[same.reshape(-1)], own)
    size = np.bincount(own, minlength=len(v)).astype(float)
    total = v * size[:, None]
    ids = np.flatnonzero(size)
    mean = total[ids] / size[ids, None]
    near, gap = np.full(len(v), -1), np.full(len(v), np.inf)
    stale = ids
    while len(ids) > 1:
        tile = max(1, room // len(ids))
        for k in range(0, len(stale), tile):
            some = stale[k : k + tile]
            d = 1 - (total[some] / size[some, None]) @ mean.T
            d[np.arange(len(some)), np.searchsorted(ids, some)] = np.inf
            at = d.argmin(1)
            near[some], gap[some] = ids[at], d[np.arange(len(some)), at]
        ids = ids[gap[ids] <= threshold]  # the others are done
        pair = ids[(near[near[ids]] == ids) & (ids < near[ids]) & (gap[near[ids]] <= threshold)]
        if not len(pair) and len(ids):  # ties: the nearest of all
            pair = ids[[gap[ids].argmin()]]
        if not len(pair):
            break
        gone = near[pair]
        into = np.arange(len(v))
        into[gone] = pair
        own = into[own]
        total[pair] += total[gone]
        size[pair] += size[gone]
        ids = np.setdiff1d(ids, gone, assume_unique=True)
        mean = total[ids] / size[ids, None]
        stale = ids[np.isin(ids, pair) | np.isin(near[ids], np.concatenate([pair, gone]))]
    first = np.full(len(v), len(v))
    np.minimum.at(first, own, np.arange(len(v)))
    return first[own].tolist()


def induce_vocabulary(vectors: DataFrame, block: str, key: str, threshold: float = 0.45) -> DataFrame:
    """(block, key, cluster): average-linkage clusters by cosine distance under ``threshold``; the cluster
    is its smallest key. A block is one group: its vectors are held, and compared a tile at a time."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        names = pdf[key].to_numpy()
        return pd.DataFrame({block: pdf[block].iloc[0], key: names, "cluster": names[average_linkage(np.stack(pdf.vec.to_numpy()).astype(float), threshold)]})

    kinds = dict(vectors.dtypes)
    return vectors.groupBy(block).applyInPandas(one, f"{block} {kinds[block]}, {key} {kinds[key]}, cluster {kinds[key]}")


def harvest_labels(labels: DataFrame, doc: str, label: str, least: int = 2) -> DataFrame:
    """(label, n_docs): case-folded labels in at least ``least`` documents."""
    return labels.groupBy(F.lower(F.trim(label)).alias("label")).agg(F.countDistinct(doc).alias("n_docs")).where(F.col("n_docs") >= least)


#: Archetypes of incidents, the weight of each object for them, and the
#: objects of which one must be there.
ARCHETYPES = {
    "Vehicle collision / traffic accident": (
        {"car": 1.0, "truck": 1.0, "bus": 1.0, "motorcycle": 1.0, "bicycle": 1.0, "van": 1.0, "person": 0.6, "debris": 0.8, "traffic cone": 0.4, "traffic light": 0.2, "broken glass": 0.7},
        ["car", "truck", "bus", "motorcycle", "bicycle", "van"],
    ),
    "Fire / smoke incident": ({"fire": 1.5, "smoke": 1.2, "person": 0.3}, ["fire", "smoke"]),
    "Fall from height": ({"ladder": 1.2, "scaffolding": 1.2, "person": 0.8, "fallen person": 1.5}, ["ladder", "scaffolding", "fallen person"]),
    "Slip / trip hazard": ({"spilled liquid": 1.3, "wet floor sign": 1.0, "fallen person": 1.2, "person": 0.5}, ["spilled liquid", "wet floor sign", "fallen person"]),
    "Industrial / material handling incident": ({"forklift": 1.3, "pallet": 0.8, "debris": 0.6, "person": 0.6, "helmet": 0.3}, ["forklift", "pallet"]),
}


def rule_scores(labels: DataFrame, key: str, label: str, rules: dict = ARCHETYPES) -> DataFrame:
    """(key, verdict, confidence): the archetype of highest total weight among those whose
    gate is met, first declared of equals; its share of all totals, 3 places."""
    spark = labels.sparkSession
    rows = [(i, name, obj, w, obj in gate) for i, (name, (signals, gate)) in enumerate(rules.items()) for obj, w in signals.items()]
    dim = F.broadcast(spark.createDataFrame(rows, "pos int, verdict string, object string, weight double, gate boolean"))  # a few dozen rows
    seen = labels.select(key, F.lower(label).alias("object")).distinct()
    total = seen.join(dim, "object").groupBy(key, "pos", "verdict").agg(F.sum("weight").alias("score"), F.max("gate").alias("open")).where("open")
    best = total.groupBy(key).agg(F.min_by("verdict", F.struct(-F.col("score"), F.col("pos"))).alias("verdict"), F.round(F.max("score") / F.sum("score"), 3).alias("confidence"))
    return labels.select(key).distinct().join(best, key, "left").select(key, F.coalesce("verdict", F.lit("Undetermined incident")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
