"""Search, traces, themes and differences over a corpus."""

import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions.vectors import dot
from folioquery.operators.folds import walked


def search(rows: DataFrame, query: Column, vector: str, key: str, top: int = 8, floor: float = 0.2) -> DataFrame:
    """(key, score, rank): scores rounded to 4 places, ordered, cut to ``top``, then those
    under ``floor`` go. Ties keep key order."""
    best = rows.select(key, F.round(dot(F.col(vector), query), 4).alias("score")).orderBy(F.desc("score"), key).limit(top)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)).cast("long"))  # ``top`` rows
    return ranked.where(F.col("score") >= floor)


def two_level(scored: DataFrame, doc: str, key: str, per_doc: int, total: int) -> DataFrame:
    """The best ``per_doc`` rows of each document, then the best ``total`` of those."""
    inner = W.partitionBy(doc).orderBy(F.desc("score"), key)
    kept = scored.withColumn("doc_rank", F.row_number().over(inner).cast("long")).where(F.col("doc_rank") <= per_doc)
    best = kept.orderBy(F.desc("score"), doc, key).limit(total)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), doc, key)).cast("long"))


def trace(scored: DataFrame, doc: str, key: str, floor: float = 0.35, per_doc: int = 8, total: int = 80) -> DataFrame:
    """(doc, hits, best): rows at or over ``floor``, at most ``per_doc`` a document and ``total`` in all."""
    kept = two_level(scored.where(F.col("score") >= floor), doc, key, per_doc, total)
    return kept.groupBy(doc).agg(F.count("*").alias("hits"), F.max("score").alias("best"))


def version_diff(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, unchanged, added, removed) of two documents' lines as multisets.

    lines: doc_id, norm; pairs: a, b.
    """
    n = lines.groupBy("doc_id", "norm").agg(F.count("*").alias("n"))
    left = pairs.join(n.select(F.col("doc_id").alias("a"), "norm", "n"), "a")
    right = pairs.join(n.select(F.col("doc_id").alias("b"), "norm", F.col("n").alias("m")), "b")
    both = left.join(right, ["a", "b", "norm"], "full").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    return both.groupBy("a", "b").agg(
        F.sum(F.least("n", "m")).alias("unchanged"), F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("removed")
    )


def anchors(rows: DataFrame, by: list[str], order: str, partner: str) -> DataFrame:
    """rows with ``anchor``: the partner of the nearest matched row before, or null."""
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("anchor", F.last(partner, ignorenulls=True).over(before))


def removed(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, seg, anchor): the lines of a that b hasn't, with their place in a; anchor is the partner of the nearest
    line before that b has, which is the first equal line of b, or null.

    lines: doc_id, marks, an array with a value for each line that equal lines share, null for what doesn't count;
    pairs: a, b. The marks of a document are dealt once for each of its pairs, and a pair's rows are made where they meet.
    """
    side = lambda n, c: F.struct(F.col(c).alias("doc_id"), F.lit(n).alias("side"))
    sides = pairs.select("a", "b", F.explode(F.array(side(0, "a"), side(1, "b"))).alias("s")).select("a", "b", "s.*")
    met = lines.select("doc_id", "marks").join(sides, "doc_id").select("a", "b", "side", "marks").repartition("a", "b")
    rows = met.select("a", "b", "side", F.posexplode_outer("marks").alias("seg", "mark")).where("mark is not null")
    first = F.min(F.when(F.col("side") == 1, F.col("seg"))).over(W.partitionBy("a", "b", "mark"))
    rows = rows.select("a", "b", "side", F.col("seg").cast("long").alias("seg"), first.cast("long").alias("partner")).where("side = 0")
    return anchors(rows, ["a", "b"], "seg", "partner").where("partner is null").select("a", "b", "seg", "anchor")


def _shared(left: list[set], right: list[set], least: float) -> list[tuple[int, int, int]]:
    """(i, j, words in common) of sets that share ``least`` of each one's words or more. Such sets share one of the
    rarest words of either, of all but that share and one more, so only those are looked up."""
    seen = Counter(w for ws in (*left, *right) for w in ws)
    rare = lambda ws: sorted(ws, key=lambda w: (seen[w], w))[: len(ws) - math.ceil(least * len(ws)) + 1]
    index, out = defaultdict(list), []
    for j, ws in enumerate(right):
        for w in rare(ws):
            index[w].append(j)
    for i, ws in enumerate(left):
        n = len(ws)
        for j in {j for w in rare(ws) for j in index.get(w, ())}:
            m = len(right[j])
            if min(n, m) >= least * max(n, m) and (c := len(ws & right[j])) >= least * max(n, m):
                out.append((i, j, c))
    return out


def similar_passages(segs: DataFrame, pairs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, i, j, score): passages of paired documents by common words over all words of the two, rounded to 4 places,
    at ``threshold`` or more. segs: doc_id, seg, norm; pairs: a, b. A pair's passages are held while pairs stream by."""
    kinds, least = dict(segs.dtypes), threshold - 0.0001
    side = lambda n, c: pairs.select(F.col(c).alias("doc_id"), "a", "b", F.lit(n).alias("side"))
    rows = segs.select("doc_id", "seg", "norm").join(side(0, "a").union(side(1, "b")), "doc_id").drop("doc_id")

    def one(rows: list[dict]):
        cut = next((k for k, r in enumerate(rows) if r["side"]), len(rows))
        ws = [set(r["norm"].split(" ")) for r in rows]
        return [(rows[0]["a"], rows[0]["b"], rows[i]["seg"], rows[cut + j]["seg"], c, len(ws[i]), len(ws[cut + j])) for i, j, c in _shared(ws[:cut], ws[cut:], least)]

    found = walked(rows, ["a", "b"], ["side", "seg"], one, f"a {kinds['doc_id']}, b {kinds['doc_id']}, i {kinds['seg']}, j {kinds['seg']}, c long, n long, m long")
    scored = found.withColumn("score", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 4))
    return scored.select("a", "b", "i", "j", "score").where(F.col("score") >= threshold)


def greedy_pairs(scored: DataFrame, by: list[str], left: str, right: str, threshold: float = 0.6) -> DataFrame:
    """One-to-one pairs: best score first, then larger left and right. One group of ``by``
    is walked in order; its candidates come from a step that has pruned them."""
    kinds = dict(scored.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, left, right, "score"])

    def one(rows: list[dict]):
        used_a, used_b, out = set(), set(), []
        for r in sorted(rows, key=lambda r: (r["score"], r[left], r[right]), reverse=True):
            if r[left] not in used_a and r[right] not in used_b:
                used_a.add(r[left])
                used_b.add(r[right])
                out.append(tuple(r[c] for c in (*by, left, right, "score")))
        return out

    return walked(scored.where(F.col("score") >= threshold), by, [], one, schema)


def cluster_terms(words: DataFrame, stop: list[str], top: int = 3) -> DataFrame:
    """(cluster, word, n, weight, rank): words that are frequent in a cluster for their
    frequency overall, weight n / sqrt(n overall). words: cluster, word."""
    n = words.where(~F.col("word").isin(stop)).groupBy("cluster", "word").agg(F.count("*").alias("n"))
    whole = n.groupBy("word").agg(F.sum("n").alias("all"))
    w = n.join(whole, "word").withColumn("weight", F.round(F.col("n") / F.sqrt("all"), 6))
    order = W.partitionBy("cluster").orderBy(F.desc("weight"), "word")
    return w.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("cluster", "word", "n", "weight", "rank")


def themes(vectors: DataFrame, key: str, vector: str, k: int = 8, seed: int = 7) -> DataFrame:
    """(key, cluster, x, y): k-means clusters and two principal components scaled to 0..1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    labelled = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(rows).transform(rows)
    flat = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(labelled).withColumn("p", vector_to_array("p"))
    span = flat.agg(*[f(F.col("p")[i]).alias(f"{n}{i}") for i in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scale = lambda i: (F.col("p")[i] - span[f"lo{i}"]) / max(span[f"hi{i}"] - span[f"lo{i}"], 1e-12)
    return flat.select(key, "cluster", scale(0).alias("x"), scale(1).alias("y"))
