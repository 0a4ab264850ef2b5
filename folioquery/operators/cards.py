"""Score cards: where nodes were found, how far tokens are covered, tiers of gold."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.metrics import _ratio


def node_card(nodes: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Counts of a score card by ``by`` ([]: one card). nodes: gold and pred (numbers of boxes;
    0: absent, or not found), iou, exact. A node counts as localised if its boxes are exactly
    the gold ones or their area agrees by ``least``."""
    here, found = F.col("gold") > 0, F.col("pred") > 0
    hit = here & found & (F.col("exact") | (F.col("iou") >= least))
    return nodes.groupBy(*by).agg(
        F.count("*").alias("n_nodes"),
        F.count_if(~here).alias("n_absent"),
        F.count_if(~here & ~found).alias("n_absent_correct"),
        F.count_if(here & ~found).alias("n_missed"),
        F.count_if(hit).alias("n_localized"),
        F.count_if(here & F.col("exact")).alias("n_exact"),
        F.coalesce(F.sum(F.when(here & found, F.col("iou"))), F.lit(0.0)).alias("iou_sum"),
    )


def claims(furniture: DataFrame, claimed: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, n_furniture, n_false_claims): boxes that belong to no node, and those that a node claims."""
    hit = furniture.join(claimed.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return hit.groupBy(*by).agg(F.count("*").alias("n_furniture"), F.count("_hit").alias("n_false_claims"))


def merge_cards(cards: DataFrame, by: list[str]) -> DataFrame:
    """Cards pooled by their counts, so that every node weighs the same."""
    return cards.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cards.columns if c.startswith(("n_", "iou_"))])


def card_rates(cards: DataFrame, places: int = 6) -> DataFrame:
    """cards with their rates; null where there is nothing to divide by."""
    present = F.col("n_nodes") - F.col("n_absent")
    rates = [_ratio(F.col("n_localized"), present, places).alias("localization_accuracy"), _ratio(F.col("iou_sum"), present, places).alias("mean_iou"), _ratio(F.col("n_absent_correct"), F.col("n_absent"), places).alias("absent_accuracy")]
    if "n_furniture" in cards.columns:
        rates.append(_ratio(F.col("n_false_claims"), F.col("n_furniture"), places).alias("false_claim_rate"))
    return cards.select("*", *rates)


def coverage_rates(rows: DataFrame, by: list[str], placed: Column, owned: Column, tokens: Column) -> DataFrame:
    """(by, placement_rate, token_coverage): placed nodes of all, owned tokens of all; 0 without any."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*by).agg(zero(_ratio(F.count_if(placed), F.count("*"))).alias("placement_rate"), zero(_ratio(F.sum(owned), F.sum(tokens))).alias("token_coverage"))


def ambiguity_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, accuracy, accuracy_up_to_ambiguity). rows: gold and pred owners (null: none), the
    owners' texts gold_text and pred_text; a wrong owner of the same text is no error in the
    second. 0 without rows."""
    right = F.col("gold").eqNullSafe(F.col("pred"))
    same = F.col("gold_text") == F.col("pred_text")
    zero = lambda c: F.coalesce(_ratio(c, F.count("*")), F.lit(0.0))
    return rows.groupBy(*by).agg(zero(F.count_if(right)).alias("accuracy"), zero(F.count_if(right | F.coalesce(same, F.lit(False)))).alias("accuracy_up_to_ambiguity"))


def composition(gold: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_gold_nodes, human, audited, oracle): nodes by the tier that vouches for them."""
    return gold.groupBy(*by).agg(F.count("*").alias("n_gold_nodes"), *[F.count_if(F.col("tier") == t).alias(t) for t in ("human", "audited", "oracle")])


def fully_rendered(entries: DataFrame, by: list[str], wanted: int) -> DataFrame:
    """(by, n): groups of which at least ``wanted`` variants compiled. entries: by, status."""
    return entries.where("status = 'compiled'").groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= max(1, wanted))


def word_distance(a: list[str], b: list[str]) -> int:
    """Words to put in, take out or replace to make ``b`` of ``a``. Rows of the table of distances are
    kept as differences, one bit a word of ``a``, so a word of ``b`` costs some operations on whole
    numbers of that many bits, and no more is held."""
    n = min(len(a), len(b))
    i = next((i for i in range(n) if a[i] != b[i]), n)
    j = next((j for j in range(n - i) if a[-1 - j] != b[-1 - j]), n - i)
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    all_, last, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = all_, 0
    for w in b:
        same = where.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | all_ & ~(across | up), up & across
        score += bool(rise & last) - bool(fall & last)
        rise = rise << 1 | 1
        keep = same | down
        up, down = all_ & (fall << 1 | ~(keep | rise)), rise & keep & all_
    return score


def with_wer(rows: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """(key, word_edits, wer): word errors over the words of the reference, at least one. Null
    texts have no words. Texts of any length count whole; batches of rows go to Python."""
    import pandas as pd

    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([word_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")

    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    each = rows.select(key, words(ref).alias("_r"), words(hyp).alias("_h"))
    each = each.select(key, F.size("_r").alias("_n"), F.pandas_udf(edits, "long")("_r", "_h").alias("word_edits"))
    return each.select(key, "word_edits", F.round(F.col("word_edits") / F.greatest(F.col("_n"), F.lit(1)), 4).alias("wer"))
