"""Queries on search, themes and versions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions.vectors import dot
from folioquery.operators import align, corpus
from folioquery.plans.model import SEGMENTS_SQL, lines, segments
from folioquery.plans.registry import query

SCORED_SQL = """q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
scored AS (SELECT label, vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 4) AS score FROM embeddings, q)"""


def _first(read):
    """The query vector: one row."""
    return read("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def _scored(read):
    e = read("embeddings").crossJoin(F.broadcast(_first(read)))  # one row
    return e.select("label", "vec_id", F.round(dot(F.col("embedding"), F.col("q")), 4).alias("score"))


@query(
    "cosine_join_floor",
    """SELECT a.label, count(*) AS n_pairs, max(round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 4)) AS best
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 4) >= 0.2 GROUP BY a.label""",
    python=True,
)
def cosine_join_floor(read):
    e = read("embeddings")
    left, right = e.select("label", F.col("vec_id").alias("node"), F.col("embedding").alias("vec")), e.select("label", F.col("vec_id").alias("box"), F.col("embedding").alias("vec2"))
    got = align.align_vectors(left, right, "label", 0.2).where("node < box")
    return got.groupBy("label").agg(F.count("*").alias("n_pairs"), F.max("score").alias("best"))


@query(
    "semantic_search_topk",
    f"WITH {SCORED_SQL}, t AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM scored) SELECT vec_id, score, rank FROM t WHERE rank <= 8 AND score >= 0.2",
)
def semantic_search_topk(read):
    e = read("embeddings").crossJoin(F.broadcast(_first(read)))
    return corpus.search(e, F.col("q"), "embedding", "vec_id")


@query(
    "corpus_search_two_level",
    f"""WITH {SCORED_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS doc_rank FROM scored WHERE score >= 0.2),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, label, vec_id) AS rank FROM a WHERE doc_rank <= 5) SELECT label, vec_id, score, doc_rank, rank FROM b WHERE rank <= 12""",
)
def corpus_search_two_level(read):
    return corpus.two_level(_scored(read).where("score >= 0.2"), "label", "vec_id", 5, 12)


@query(
    "concept_trace",
    f"""WITH {SCORED_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS d FROM scored WHERE score >= 0.1),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, label, vec_id) AS r FROM a WHERE d <= 8) SELECT label, count(*) AS hits, max(score) AS best FROM b WHERE r <= 80 GROUP BY label""",
)
def concept_trace(read):
    return corpus.trace(_scored(read), "label", "vec_id", 0.1)


@query(
    "cluster_terms",
    r"""WITH w AS (SELECT lang AS cluster, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents), n AS (SELECT cluster, word, count(*) AS n FROM w WHERE word NOT IN ('that', 'with', 'from') GROUP BY ALL),
a AS (SELECT word, sum(n) AS a FROM n GROUP BY word), s AS (SELECT cluster, n.word, n, round(n / sqrt(a), 6) AS weight FROM n JOIN a ON n.word = a.word)
SELECT cluster, word, n, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, word) AS rank FROM s) WHERE rank <= 3""",
)
def cluster_terms(read):
    words = read("documents").select(F.col("lang").alias("cluster"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return corpus.cluster_terms(words, ["that", "with", "from"])


@query("kmeans_theme_sizes")
def kmeans_theme_sizes(read):
    return corpus.themes(read("embeddings"), "vec_id", "embedding").groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))


VERSIONS_SQL = "pairs AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS b FROM documents)"


def _pairs(docs):
    after = F.lead("doc_id").over(W.partitionBy("source", "lang").orderBy("doc_id"))
    return docs.select(F.col("doc_id").alias("a"), after.alias("b")).where("b is not null")


@query(
    "doc_diff_counts",
    f"""WITH {SEGMENTS_SQL.strip()}, {VERSIONS_SQL}, c AS (SELECT doc_id, norm, count(*) AS n FROM segments GROUP BY ALL),
l AS (SELECT a, b, norm, n FROM pairs JOIN c ON c.doc_id = a WHERE b IS NOT NULL), r AS (SELECT a, b, norm, n AS m FROM pairs JOIN c ON c.doc_id = b),
j AS (SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b AND l.norm = r.norm)
SELECT a, b, CAST(sum(least(n, m)) AS BIGINT) AS unchanged, CAST(sum(greatest(m - n, 0)) AS BIGINT) AS added, CAST(sum(greatest(n - m, 0)) AS BIGINT) AS removed FROM j GROUP BY a, b""",
)
def doc_diff_counts(read):
    docs = read("documents")
    return corpus.version_diff(segments(docs).select("doc_id", "norm"), _pairs(docs))


@query("doc_diff_greedy", python=True)
def doc_diff_greedy(read):
    """One-to-one passages of consecutive documents by common words, at 0.6 or more."""
    docs = read("documents")
    scored = corpus.similar_passages(segments(docs), _pairs(docs))
    return corpus.greedy_pairs(scored, ["a", "b"], "i", "j").groupBy("a", "b").agg(F.count("*").alias("matched"), F.round(F.avg("score"), 4).alias("mean_score"))


@query(
    "diff_anchor_last_match",
    f"""WITH {SEGMENTS_SQL.strip()}, {VERSIONS_SQL}, f AS (SELECT doc_id, norm, min(seg) AS at FROM segments GROUP BY ALL),
m AS (SELECT a, b, s.seg, f.at AS partner FROM pairs JOIN segments s ON s.doc_id = a LEFT JOIN f ON f.doc_id = b AND f.norm = s.norm WHERE b IS NOT NULL),
x AS (SELECT *, last_value(partner IGNORE NULLS) OVER (PARTITION BY a, b ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM m)
SELECT a, b, seg, anchor FROM x WHERE partner IS NULL""",
)
def diff_anchor_last_match(read):
    """Where a removed passage stood: the partner of the last matched one before it."""
    docs = read("documents")
    mark = F.transform("norms", lambda n: F.when(n != "", F.unhex(F.sha2(n, 256))))  # what is dealt for a passage
    return corpus.removed(lines(docs).select("doc_id", mark.alias("marks")), _pairs(docs))


@query(
    "context_budget_prefix",
    f"""WITH {SEGMENTS_SQL.strip()}, r AS (SELECT doc_id, seg, length(norm) AS n, sum(length(norm)) OVER (PARTITION BY doc_id ORDER BY seg ROWS UNBOUNDED PRECEDING) AS upto FROM segments)
SELECT doc_id, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_chars FROM r WHERE upto <= 2000 GROUP BY doc_id""",
)
def context_budget_prefix(read):
    """Passages that fit a budget of 2,000 characters, up to the first that doesn't."""
    upto = F.sum(F.length("norm")).over(W.partitionBy("doc_id").orderBy("seg").rowsBetween(W.unboundedPreceding, 0))
    s = segments(read("documents")).withColumn("upto", upto).where("upto <= 2000")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(F.length("norm")).alias("n_chars"))


@query(
    "sentence_groups",
    r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS word, generate_subscripts(string_split_regex(text, '[ \t\n\x0B\f\r]+'), 1) AS pos FROM documents),
f AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]["'')\]]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM w WHERE word <> ''),
s AS (SELECT doc_id, g, count(*) AS n FROM f GROUP BY ALL) SELECT doc_id, count(*) AS n_sentences, max(n) AS longest FROM s GROUP BY doc_id""",
)
def sentence_groups(read):
    """Islands of words that end in a sentence mark and closers."""
    w = read("documents").select("doc_id", F.posexplode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("pos", "word")).where("word <> ''")
    ends = F.when(F.col("word").rlike(r"""[.!?]["')\]]*$"""), 1).otherwise(0)
    g = F.coalesce(F.sum(ends).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return w.withColumn("g", g).groupBy("doc_id", "g").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max("n").alias("longest"))
