"""Connected components of a distributed edge list by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.plans.workspace import Workspace

ROWS_A_FILE = 10_000


def connected_components(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is its smallest node.

    Each round hangs larger neighbours on the smallest one (large star), then smaller
    ones (small star), until nothing changes. A hub's rows meet only in partial
    minima and in joins, which Spark can split, never in a window or a list. Rounds
    are written tables, so lost executors cost one round at most; each is written in no
    more files than its rows need. Nulls and loops are ignored; an empty edge list gives
    an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = ws.table(e.where("u <> v").distinct(), "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        new = ws.table(small.where("u <> v").distinct().coalesce(_files(mark[0])), "edges")
        ws.drop(e)
        e, was, mark = new, mark, _mark(new)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", F.col("v").alias("w")).distinct().coalesce(_files(mark[0]))
    )


def _files(rows: int) -> int:
    """Files of a table of about so many edges. Each costs tasks of the next round, and on a
    local file system some short processes of its executor."""
    return -(-rows // ROWS_A_FILE) or 1


def _mark(e: DataFrame):
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(r)
