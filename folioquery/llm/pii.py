"""Personal data: patterns propose, checksums confirm, nearby words adjust the score."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.llm import spans as S

#: Patterns. Possessive repeats and look-behinds match what the plain forms match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: Checked before the pattern: characters without which it can't match.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Score before context, words that raise it and words that lower it, within REACH characters.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
RAISE = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|whatsapp",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
LOWER = {"email": "example", "ip": "version|release|section", "card": "order|invoice|isbn|serial", "phone": "order|serial|isbn", "iban": "serial|part", "ssn": "part|serial|order|isbn"}
REACH = 40


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.cast("int").alias("d"), (i % 2).alias("odd")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x["odd"] == 0, x["d"]).otherwise(2 * x["d"] - F.when(x["d"] > 4, 9).otherwise(0)))
    return (n > 0) & (total % 10 == 0)


def iban_ok(raw: Column) -> Column:
    """Whether letters and digits (blanks left out) have remainder 1 modulo 97, 15 to 34 long."""
    s = F.regexp_replace(raw, " ", "")
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97),
    )
    return F.length(s).between(15, 34) & (rest == 1)


def valid(span: Column, kind: str) -> Column:
    text = span["text"]
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn_ok(digits)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return iban_ok(text)
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9..)-|-00-|-0000$")
    return F.lit(True)


def score(blocks: Column, span: Column, kind: str) -> Column:
    """PRIOR, +0.2 beside a raising and -0.3 beside a lowering word, held in 0 to 1. blocks: of the text."""
    before = S.cut(blocks, F.greatest(span["start"] - REACH, F.lit(0)), F.least(span["start"], F.lit(REACH)))
    near = F.lower(F.concat_ws(" ", before, S.cut(blocks, span["end"], F.lit(REACH))))
    up = F.when(near.rlike(f"(?<![a-z])(?:{RAISE[kind]})"), 0.2).otherwise(0.0)
    down = F.when(near.rlike(f"(?<![a-z])(?:{LOWER[kind]})"), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.lit(PRIOR[kind]) + up - down, 2)))


def _scored(text: Column, kind: str) -> Column:
    found = F.filter(S.find(text, kind, PATTERNS[kind]), lambda s: valid(s, kind))
    one = lambda b, s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "text")], score(b, s, kind).alias("score"))
    each = lambda fs: S.bound(S.blocks(text), lambda b: F.transform(fs, lambda s: one(b, s)))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,score:double>>")
    return S.bound(found, lambda fs: F.when(F.size(fs) > 0, each(fs)).otherwise(none))


def spans_of(text: Column, threshold: float = 0.5) -> Column:
    """array<struct<kind, start, end, text, score>>, by start and kind.

    Base kinds keep every confirmed match; the kinds that are added (iban, ssn) keep
    those that reach ``threshold``. Without any digit or "@" a text has no span.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,score:double>>")
    parts = []
    for kind in KINDS:
        scored = _scored(text, kind)
        if kind not in BASE:
            scored = F.filter(scored, lambda s: s["score"] >= threshold)
        if kind in NEEDS:
            scored = F.when(text.contains(NEEDS[kind]), scored).otherwise(none)
        parts.append(scored)
    return F.when(text.rlike("[0-9@]"), S.ordered(F.concat(*parts), KINDS)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The kept columns and ``pii``, the spans of spans_of(). One output row for each
    input row; a null text counts as empty; repeated rows and ids don't matter; other
    columns are ignored."""
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).select(*keep, spans_of(F.col("_t"), threshold).alias("pii"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets; where
    spans overlap, one mark covers them all. Null stays null."""
    cols = docs.columns
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(text).alias("t"), spans_of(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    # the end of all spans before each span; one that starts before it is under their mark
    most = S.running(F.transform("s", lambda x: x["end"]), F.greatest)
    found = found.withColumn("b", S.blocks(F.col("t"))).withColumn("upto", F.concat(F.array(F.lit(0)), most))

    def put(x, i):
        last = F.get("upto", i)
        mark = F.concat(S.cut(F.col("b"), last, x["start"] - last), F.lit("<"), x["kind"], F.lit(">"))
        return F.when(x["start"] >= last, mark).otherwise("")

    end = F.element_at("upto", -1)
    out = F.when(F.size("s") > 0, F.concat(F.array_join(F.transform("s", put), ""), S.cut(F.col("b"), end, F.length("t") - end))).otherwise(F.col("t"))
    return found.select(*[out.alias(c) if c == text else F.col("row")[c].alias(c) for c in cols])


def pii_query(docs: DataFrame) -> DataFrame:
    """The contract's columns and the largest score of a document's spans; cases as in find_pii()."""
    found = find_pii(docs)
    base = F.filter("pii", lambda s: s["kind"].isin(BASE))
    return found.select(
        "doc_id",
        *[S.count_of(F.col("pii"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(S.written(base), 256).alias("base_sha256"),
        S.written(F.col("pii")).alias("spans"),
        F.coalesce(F.round(F.array_max(F.transform("pii", lambda s: s["score"])), 2), F.lit(0.0)).alias("top_score"),
    )
