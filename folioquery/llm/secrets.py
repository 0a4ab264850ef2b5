"""Secrets: patterns propose candidates; how widely a candidate is shared tells copied
examples from one owner's live-looking credentials."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm import spans as S
from folioquery.plans.workspace import Workspace

PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "vendor": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|sk_live_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{20,}+)",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "pem": r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----",
}
#: What has to be in the text for the pattern to match; asked first.
NEEDS = {"assign": r"[:=]", "access": "AKIA", "vendor": "gh[pousr]_|sk_live_|xox[abprs]-", "jwt": "eyJ", "pem": "PRIVATE KEY-----"}
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "vendor", "jwt", "pem"]
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+"""


def value_of(span: Column) -> Column:
    """The secret itself: what is assigned, else the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_replace(span["text"], _VALUE, "")).otherwise(span["text"])


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, text, value>> by start and kind, with short matches dropped."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")
    parts = []
    for kind in KINDS:
        found = S.find(text, kind, PATTERNS[kind])
        if kind == "assign":
            found = F.filter(found, lambda s: F.length(value_of(s)) >= 8)
        elif kind == "access":
            found = F.filter(found, lambda s: F.length(s["text"]) >= 16)
        if kind in NEEDS:
            found = F.when(text.rlike(NEEDS[kind]), found).otherwise(none)
        parts.append(found)
    spans = S.ordered(F.concat(*parts), KINDS)
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), value_of(s).alias("value")))


def scan(docs: DataFrame, owner: str, repository: str, text: str = "text", keep: tuple = ("doc_id",), shared_by: int = 3) -> DataFrame:
    """The kept columns and ``found``, the candidates, each with ``owners`` and
    ``repositories`` (how many distinct ones have its value in all documents) and ``live``.

    owner, repository: SQL expressions over ``docs`` that say whose a row is. A value is
    hashed; at ``shared_by`` owners or more it is a copied example, else it looks live and
    belongs to its few owners. Null owners count as one owner. One output row for each
    input row; null texts count as empty; repeated ids don't matter. A value that very many
    rows have is one row on the counted side of the join, so Spark can split its rows.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *keep,
        F.coalesce(F.expr(owner).cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(F.expr(repository).cast("string"), F.lit("")).alias("_repo"),
        candidates(t).alias("found"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = ws.table(rows, "found")
    name = lambda s: F.sha2(s["value"], 256)
    cand = rows.where(F.size("found") > 0).select("_row", "_owner", "_repo", F.posexplode(F.transform("found", name)).alias("_pos", "_h"))
    seen = cand.groupBy("_h", "_owner", "_repo").agg(F.lit(1).alias("one")).groupBy("_h", "_owner").agg(F.count("*").alias("r"))
    seen = seen.groupBy("_h").agg(F.count("*").alias("owners"), F.sum("r").alias("repos"))
    counts = cand.select("_row", "_pos", "_h").join(seen, "_h").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "owners", "repos"))).alias("_of"))

    def judged(s, of):
        return F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "text", "value")], of["owners"].alias("owners"), of["repos"].alias("repositories"), (of["owners"] < shared_by).alias("live"))

    none = F.array().cast("array<struct<_pos:int,owners:bigint,repos:bigint>>")
    return rows.join(counts, "_row", "left").select(*keep, F.zip_with("found", F.coalesce("_of", none), judged).alias("found"))


def secrets_query(docs: DataFrame) -> DataFrame:
    """The contract's columns; ``verdicts`` (live or example, owners and repositories of
    each span, in their order), counts of both, and the largest counts of a document. The
    source stands for the owner, source and language for the repository. ASCII letters
    only in either case; rules for nulls and repeats as in scan()."""
    found = scan(docs, "source", "concat_ws('/', source, lang)")
    base = F.filter("found", lambda s: s["kind"].isin(BASE))
    said = F.transform("found", lambda s: F.concat_ws(":", F.when(s["live"], "live").otherwise("example"), s["owners"].cast("string"), s["repositories"].cast("string")))
    most = lambda c: F.coalesce(F.array_max(F.transform("found", lambda s: s[c])), F.lit(0)).cast("long").alias(f"max_{c}")
    return found.select(
        "doc_id",
        *[S.count_of(F.col("found"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(S.written(base), 256).alias("base_sha256"),
        S.written(F.col("found")).alias("spans"),
        F.array_join(said, ",").alias("verdicts"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        most("owners"),
        most("repositories"),
    )
