"""Benchmark decontamination by winnowing, in DataFrame functions only.

Hashes of K consecutive words; in every window of W such hashes the least is kept.
Two texts that share SPAN = K + W - 1 words in a row keep the same hash for that
span, so a document window is a candidate exactly if its least hash is one of the
benchmark's; candidates are then compared word by word with the benchmark's windows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.plans.workspace import Workspace

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN, K = 8, 4
#: Up to so many benchmark fingerprints travel inside the plan; more are joined.
IN_PLAN = 30_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _hashes(w: str, k: int) -> str:
    """SQL: hash of each k consecutive words of array w (at least k long)."""
    gram = ", ".join(f"get(h, i + {j})" for j in range(k))
    return f"transform(array(transform({w}, x -> xxhash64(x))), h -> transform(sequence(0, size(h) - {k}), i -> xxhash64({gram})))[0]"


def fingerprints(w: str, span: int) -> str:
    """SQL: for each start of ``span`` words, the least of its k-gram hashes."""
    k = min(K, span)
    least = f"array_min(slice(g, i + 1, {span - k + 1}))" if span > k else "get(g, i)"
    return f"case when size({w}) < {span} then array() else transform(array({_hashes(w, k)}), g -> transform(sequence(0, size(g) - {span - k + 1}), i -> {least}))[0] end"


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, size, window, print): distinct windows of each item with their fingerprint.

    An item of fewer words than ``span`` is one window; one without words has none.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(span)))
    parts = []
    for size in range(1, span + 1):
        one = items.where(F.col("n") == size)
        one = one.select("item_id", "w", F.expr(fingerprints("w", size)).alias("f"))
        one = one.select("item_id", "w", F.posexplode("f").alias("i", "print"))
        parts.append(one.select("item_id", F.lit(size).alias("size"), F.array_join(F.slice("w", F.col("i") + 1, size), " ").alias("window"), "print"))
    return reduce(DataFrame.union, parts).distinct()


def _covered(starts: str) -> str:
    """SQL: words covered by array of struct(start, size), sorted by start."""
    return f"""aggregate({starts}, struct(0 as upto, 0L as n),
        (a, s) -> struct(greatest(a.upto, s.start + s.size) as upto, a.n + greatest(0, s.start + s.size - greatest(a.upto, s.start)) as n), a -> a.n)"""


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple = ("doc_id",), span: int = SPAN, in_plan: int = IN_PLAN) -> DataFrame:
    """One row for each document row: kept columns, n_words, n_hit, ``items`` (array of
    item ids that have occurring windows, as strings in string order).

    Null texts have no words. An empty benchmark hits nothing. Repeated documents are
    judged alike; repeated items count once; items without an id are left out.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "decontam")
    bench = ws.table(benchmark_windows(benchmark.where("item_id is not null"), span), "windows")
    prints = bench.select("size", "print").distinct()
    sizes = [r["size"] for r in bench.select("size").distinct().collect()]  # at most ``span`` values
    few = prints.limit(in_plan + 1).count() <= in_plan
    held = docs.select(*keep, words(F.col(text)).alias("_w"), F.monotonically_increasing_id().alias("_row"))
    none = "cast(array() as array<struct<start:int,size:int,window:string>>)"
    take = lambda size, i: f"struct({i} as start, {size} as size, array_join(slice(_w, {i} + 1, {size}), ' ') as window)"
    if few:
        by_size: dict[int, list[int]] = {}
        for r in prints.collect():
            by_size.setdefault(r["size"], []).append(r["print"])
        parts = []
        for size, got in sorted(by_size.items()):
            inside = ", ".join(f"{x}L" if x != -(2**63) else "bigint('-9223372036854775808')" for x in got)
            parts.append(f"transform(filter(transform({fingerprints('_w', size)}, (p, i) -> if(p in ({inside}), i, -1)), i -> i >= 0), i -> {take(size, 'i')})")
        found = f"concat({', '.join(parts)})" if parts else none
        rows = ws.table(held.select(*keep, "_row", F.size("_w").cast("long").alias("n_words"), F.expr(found).alias("_c")), "candidates")
        hits = rows.where(F.size("_c") > 0).select("_row", F.explode("_c").alias("c")).select("_row", "c.*")
    else:
        rows = ws.table(held, "words")
        each = [rows.select("_row", F.lit(s).alias("size"), F.posexplode(F.expr(fingerprints("_w", s))).alias("start", "print")) for s in sizes]
        near = reduce(DataFrame.union, each).join(prints, ["size", "print"], "left_semi")
        near = near.groupBy("_row").agg(F.collect_list(F.struct("start", "size")).alias("s"))
        hits = near.join(rows.select("_row", "_w"), "_row").select("_row", F.explode(F.expr(f"transform(s, x -> {take('x.size', 'x.start')})")).alias("c")).select("_row", "c.*")
        rows = rows.select(*keep, "_row", F.size("_w").cast("long").alias("n_words"))
    #: A passage in very many documents: each distinct window meets the benchmark once.
    known = hits.select("size", "window").distinct().join(bench.select("size", "window", "item_id"), ["size", "window"])
    known = known.groupBy("size", "window").agg(F.collect_set("item_id").alias("ids"))
    good = hits.join(known, ["size", "window"]).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "size"))).alias("s"),
        F.sort_array(F.array_distinct(F.flatten(F.transform(F.collect_set("ids"), lambda a: F.transform(a, lambda x: x.cast("string")))))).alias("items"),
    )
    good = good.select("_row", "items", F.expr(_covered("s")).alias("n_hit"))
    out = rows.join(good, "_row", "left")
    return out.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontam_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for every row; cases as in scan()."""
    return scan(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with windows of fewer than ``min_items`` items, all columns."""
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(text).alias("text"))
    clean = scan(packed, benchmark, keep=("row",)).where(F.size("items") < min_items)
    return clean.select(*[F.col("row")[c].alias(c) for c in cols])
