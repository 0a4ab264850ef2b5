"""Dense and sparse vectors as array columns and as long tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column, floor: float = 1e-9) -> Column:
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(floor))
    return F.transform(a, lambda x: x / norm)


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean of the group's vectors."""
    each = rows.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vector))


def char_grams(text: Column, least: int, most: int) -> Column:
    """Character n-grams inside words, each word with a blank at both ends (a whole padded
    word that is shorter counts once)."""
    words = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    sizes = F.sequence(F.lit(least), F.lit(most))

    def grams(w):
        return F.flatten(
            F.transform(
                sizes,
                lambda n: F.when(F.length(w) < n, F.when(n == least, F.array(w)).otherwise(F.array().cast("array<string>"))).otherwise(
                    F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))
                ),
            )
        )

    return F.flatten(F.transform(words, grams))


def tfidf(rows: DataFrame, keys: list[str], grams: str, total: int) -> DataFrame:
    """(keys, gram, weight): sublinear term frequency, smoothed idf, unit length.

    ``rows`` holds one array of grams a row; ``total`` is the number of rows.
    """
    tf = rows.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    w = tf.join(df, "gram").withColumn("w", (1 + F.log("n")) * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, keys).select(*keys, "gram", (F.col("w") / F.col("norm")).alias("weight"))
