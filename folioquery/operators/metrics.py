"""Scores: pairs, confusion counts with a null class, areas, error rates."""

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.folds import walked


def _ratio(a: Column, b: Column, places: int = 6) -> Column:
    """a / b rounded, null if b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), places)


def pair_f1(rows: DataFrame, by: list[str], gold: str, pred: str) -> DataFrame:
    """n_boxes, owned, correct, precision (prec), recall and F1; gold is never null."""
    ok, owned, n = F.count_if(F.col(gold) == F.col(pred)), F.count(pred), F.count("*")
    return rows.groupBy(*by).agg(
        n.alias("n_boxes"), owned.alias("owned"), ok.alias("correct"), _ratio(ok, owned).alias("prec"), _ratio(ok, n).alias("recall"), _ratio(2 * ok, owned + n).alias("f1")
    )


def confusion(rows: DataFrame, stratum: str) -> DataFrame:
    """Counts of gold against predicted owners, null meaning none, by stratum and for all.

    A wrong owner is a false positive and a false negative; predicting an owner where
    there is none is a false attribution.
    """
    g, p = F.col("gold"), F.col("pred")
    wrong, lost, stray = g.isNotNull() & p.isNotNull() & (g != p), g.isNotNull() & p.isNull(), g.isNull() & p.isNotNull()
    return rows.groupingSets([[stratum], []], stratum).agg(
        F.count("*").alias("n"),
        F.count_if(g == p).alias("tp"),
        (F.count_if(wrong) + F.count_if(stray)).alias("fp"),
        (F.count_if(wrong) + F.count_if(lost)).alias("fn"),
        F.count_if(g.isNull() & p.isNull()).alias("tn"),
        _ratio(F.count_if(stray), F.count_if(g.isNull())).alias("false_attribution_rate"),
    ).select(F.coalesce(stratum, F.lit("all")).alias("stratum"), "n", "tp", "fp", "fn", "tn", "false_attribution_rate")


def confusion_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, F1 (null without gold, 0 without predictions), accuracy, null accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1 = F.when(tp + fn == 0, None).when(tp == 0, 0.0).otherwise(F.round(2 * tp / (2 * tp + fp + fn), 6))
    return counts.select("*", _ratio(tp, tp + fp).alias("prec"), _ratio(tp, tp + fn).alias("recall"), f1.alias("f1"), F.coalesce(_ratio(tp + tn, F.col("n")), F.lit(0.0)).alias("accuracy"))


def micro_macro(rows: DataFrame, doc: str, by: str, gold: str, pred: str) -> DataFrame:
    """Pooled F1 and the mean of documents' F1."""
    per = rows.groupBy(doc, by).agg(F.count("*").alias("n"), F.count(pred).alias("owned"), F.count_if(F.col(gold) == F.col(pred)).alias("ok"))
    f1 = F.try_divide(2.0 * F.col("ok"), (F.col("owned") + F.col("n")).cast("double"))
    return per.groupBy(by).agg(F.count("*").alias("n_docs"), _ratio(2 * F.sum("ok"), F.sum("owned") + F.sum("n")).alias("micro_f1"), F.round(F.avg(f1), 6).alias("macro_f1"))


def multiset_prf(ref: DataFrame, hyp: DataFrame, key: str, word: str) -> DataFrame:
    """Words in common, counted as often as both sides have them, by key."""
    n, m = ref.groupBy(key, word).agg(F.count("*").alias("n")), hyp.groupBy(key, word).agg(F.count("*").alias("m"))
    j = n.join(m, [key, word], "full").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    common = F.sum(F.least("n", "m"))
    return j.groupBy(key).agg(F.sum("n").alias("n_ref"), F.sum("m").alias("n_hyp"), common.alias("common"), _ratio(common, F.sum("n")).alias("recall"), _ratio(common, F.sum("m")).alias("prec"))


def text_multiset_prf(ref: DataFrame, hyp: DataFrame, key: str, text: str) -> DataFrame:
    """multiset_prf() of the words, parted by single blanks, of both sides' texts. A key's texts are held as they stream
    by, so words are neither shuffled nor joined. Null texts have no words; keys without a word have no row."""
    rows = ref.select(key, F.lit(0).alias("side"), F.col(text).alias("t")).union(hyp.select(key, F.lit(1), text)).where("t is not null")

    def one(rows: list[dict]):
        n, m = (Counter(w for r in rows if r["side"] == side for w in r["t"].split(" ")) for side in (0, 1))
        return [(rows[0][key], n.total(), m.total(), (n & m).total())]

    got = walked(rows, [key], [], one, f"{key} {dict(ref.dtypes)[key]}, n_ref long, n_hyp long, common long")
    return got.select("*", _ratio(F.col("common"), F.col("n_ref")).alias("recall"), _ratio(F.col("common"), F.col("n_hyp")).alias("prec"))


def left_out(ref: Column, hyp: Column) -> Column:
    """Whether hyp is ref with characters left out, none of them moved or new; false with a null."""
    import pandas as pd

    def held(a: pd.Series, b: pd.Series) -> pd.Series:
        def inside(x, y):
            rest = iter(x)
            return all(c in rest for c in y)

        return pd.Series([x is not None and y is not None and inside(x, y) for x, y in zip(a, b)], dtype=bool)

    return F.pandas_udf(held, "boolean")(ref, hyp)


def with_cer(rows: DataFrame, ref: str, hyp: Column) -> DataFrame:
    """rows with ``edits`` and ``cer`` (edits over reference length, 4 places, null without a reference).
    Where characters are only left out, edits are the difference in length, without a distance."""
    few = F.length(ref) - F.length(hyp)
    edits = F.when(left_out(F.col(ref), hyp), few).otherwise(F.levenshtein(F.col(ref), hyp))
    return rows.withColumn("edits", edits).withColumn("cer", _ratio(F.col("edits"), F.length(ref), 4))


def upper_median(name: str) -> Column:
    """The element at half the number of values, counted from 0, of the sorted non-null values
    of a column; values are counted, not listed."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over the characters of both texts (1 for two
    empty ones, null as empty), as the standard library's matcher finds the blocks."""
    import pandas as pd

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)

    return F.pandas_udf(ratios, "double")(a, b)
