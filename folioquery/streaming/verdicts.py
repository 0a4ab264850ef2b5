"""Verdicts on queue items: checked, merged into a table of the latest ones by micro-batches, and laid over
the working set.

The table is cut into BUCKETS by document. A batch merges the buckets it touches with their newest
version and writes them as a version of its own number, so a batch that is run again after a failure
reads what it read before and replaces what it wrote. A cleared item stays in the table as such, so
that a late older verdict doesn't bring it back.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.sources.sinks import upsert_latest

BUCKETS = 64
#: Verdicts of each queue; an item's queue is its id up to the colon.
VERDICTS = {"excluded": ["boxes", "absent", "skip"], "null": ["furniture", "node", "skip"], "audit": ["accept", "reject", "skip"]}
#: What a verdict is: seq tells verdicts of one time apart.
LOG = "doc string, id string, verdict string, boxes array<string>, node_id string, note string, ts timestamp, seq long"
KEYS, ORDER = ["doc", "id"], ["ts", "seq"]


def checked(log: DataFrame) -> DataFrame:
    """log with ``fault``: bad_item (no queue of that name), bad_verdict (not one of the queue's, nor clear),
    needs_boxes, needs_node, no_time, or null for a verdict that counts."""
    queue = F.split_part(F.coalesce("id", F.lit("")), F.lit(":"), F.lit(1))
    known = F.lit(False)
    for name, allowed in VERDICTS.items():
        known = known | ((queue == name) & F.col("verdict").isin(*allowed))
    clear = F.coalesce(F.col("verdict") == "clear", F.lit(False))
    fault = (
        F.when(~queue.isin(*VERDICTS) | F.col("doc").isNull(), "bad_item")
        .when(~clear & ~F.coalesce(known, F.lit(False)), "bad_verdict")
        .when((F.col("verdict") == "boxes") & (F.coalesce(F.size("boxes"), F.lit(0)) < 1), "needs_boxes")
        .when((F.col("verdict") == "node") & (F.coalesce("node_id", F.lit("")) == ""), "needs_node")
        .when(F.col("ts").isNull() | F.col("seq").isNull(), "no_time")
    )
    return log.withColumn("fault", fault)


def last_verdicts(log: DataFrame) -> DataFrame:
    """The last verdict of each item by time, without cleared ones. Repeated rows count once."""
    return upsert_latest(log, KEYS, ORDER)


def _newest(log: DataFrame) -> DataFrame:
    last = W.partitionBy(*KEYS).orderBy(*[F.desc(c) for c in ORDER])
    return log.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def _table(spark: SparkSession, folder: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Newest version of each bucket, of versions before a number. Only those files are read: the versions
    asked for are at most one for each bucket."""
    schema = spark.createDataFrame([], LOG + ", version long, bucket int").schema
    try:
        files = spark.read.schema(schema).option("basePath", f"{folder}/state").parquet(f"{folder}/state")
    except Exception as e:  # no batch has written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    seen = files if before is None else files.where(F.col("version") < before)
    if buckets is not None:
        seen = seen.where(F.col("bucket").isin(buckets))
    pairs = seen.groupBy("bucket").agg(F.max("version").alias("version")).collect()
    if not pairs:
        return files.limit(0)
    wanted = F.lit(False)
    for r in pairs:
        wanted = wanted | ((F.col("bucket") == r["bucket"]) & (F.col("version") == r["version"]))
    return files.where(wanted)


def merge_batch(batch: DataFrame, folder: str, number: int) -> None:
    """Merge a batch into the table as version ``number``; rows with a fault go to faults/batch=number."""
    spark = batch.sparkSession
    judged = checked(batch.select(*[c.split(" ")[0] for c in LOG.split(", ")]))
    judged.where("fault is not null").write.mode("overwrite").parquet(f"{folder}/faults/batch={number}")
    good = judged.where("fault is null").drop("fault").withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(BUCKETS)).cast("int"))
    touched = [r["bucket"] for r in good.select("bucket").distinct().collect()]  # at most BUCKETS
    if touched:
        old = _table(spark, folder, number, touched).drop("version")
        new = _newest(old.unionByName(good))
        new.withColumn("version", F.lit(number)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/version={number}")


def run_verdicts(stream: DataFrame, folder: str, checkpoint: str):
    """Merge a stream of verdicts (LOG) into the table under ``folder`` until what has arrived is merged."""
    return stream.writeStream.foreachBatch(lambda b, n: merge_batch(b, folder, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts that hold; cleared items are left out."""
    return _table(spark, folder).where("verdict <> 'clear'").drop("version", "bucket")


def working_set(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """items (doc, id, ..) with their verdict, boxes, node_id, note and ts, nulls for open ones."""
    return items.join(verdicts.drop("seq"), KEYS, "left")


def progress(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(doc, n_items, n_annotated, n_open): of each document's items those without a verdict are open;
    verdicts on items that are in no queue any more count as annotated."""
    one = items.select(*KEYS).distinct().withColumn("_i", F.lit(1)).join(verdicts.select(*KEYS, F.lit(1).alias("_v")), KEYS, "full")
    return one.groupBy("doc").agg(F.count("_i").alias("n_items"), F.count("_v").alias("n_annotated"), F.count_if(F.col("_i").isNotNull() & F.col("_v").isNull()).alias("n_open"))
