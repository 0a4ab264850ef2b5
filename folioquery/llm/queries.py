"""The registered queries of this subpackage, one for each operator, and their SQL."""

from functools import wraps

from folioquery.llm import alignment, bpe, collocation, decontam, line_dedup, near_dup, pii, quality, secrets, token_count, token_store, toxicity, url_filter
from folioquery.plans.ship import ship
from folioquery.sources.tables import table


def _over(*names: str):
    """A query over whole tables: reads them, hands the package to the executors."""

    def made(query):
        @wraps(query)
        def run(spark, folder):
            ship(spark)
            return query(*[table(spark, folder, n) for n in names])

        return run

    return made


def queries() -> dict:
    docs, marked, bench = _over("documents"), _over("documents", "labels"), _over("documents", "benchmark")
    return {
        "op1_line_dedup": docs(line_dedup.line_dedup_query),
        "op2_toxicity": marked(toxicity.toxicity_query),
        "op3_near_duplicates": docs(near_dup.near_dup_query),
        "op4_quality_rules": docs(quality.quality_query),
        "op5_bpe": docs(bpe.bpe_query),
        "op6_token_store": docs(token_store.store_query),
        "op7_decontamination": bench(decontam.decontam_query),
        "op8_pii": docs(pii.pii_query),
        "op9_secret_scan": docs(secrets.secrets_query),
        "op10_token_counts": docs(token_count.count_tokens),
        "op11_url_filter": _over("pages")(url_filter.url_query),
        "op12_collocations": docs(collocation.collocation_query),
        "op13_token_alignment": docs(alignment.alignment_query),
    }


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS sh FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT doc_id AS node, doc_id AS c FROM n UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.node),
m AS (SELECT node, min(c) AS c FROM t GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id"""

DECONTAMINATION_SQL = rf"""WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT item_id, w, least(len(w), 8) AS n FROM bw WHERE len(w) > 0),
bx AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM b, unnest(range(1, len(w) - n + 2)) t(i)),
dx AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM dw, (SELECT DISTINCT n FROM bx) z, unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT rid, n, i, item_id FROM dx JOIN bx USING (n, win)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""


def oracle_sql() -> dict:
    """Those whose whole result SQL can express; the others are tested in tests/llm."""
    return {"op3_near_duplicates": NEAR_DUPLICATES_SQL, "op7_decontamination": DECONTAMINATION_SQL, "op11_url_filter": url_filter.url_sql(), "op12_collocations": collocation.COLLOCATION_SQL}
