"""Stages of the corpus pipeline and the function that runs them in order."""

from pyspark.sql import DataFrame, SparkSession

from folioquery.llm import bpe, decontam, line_dedup, near_dup, quality
from folioquery.plans.ship import ship
from folioquery.plans.workspace import Workspace
from folioquery.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are likely junk go."""
    return quality.filter_quality(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has, but for small edits, go; emptied documents too."""
    ship(spark)
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more) the document with the smallest id stays."""
    ship(spark)
    return near_dup.drop_near_duplicates(docs, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of any benchmark item go; op7's column asks for two items."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    ship(spark)
    return bpe.bpe_query(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's
    input. An empty table gives an empty table; null and empty texts go with the first stage."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return docs
