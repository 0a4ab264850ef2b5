"""Boxes on pages: assigning lines to blocks, grouping what is left."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions.geometry import Box, union_of

#: Which extractor a block's label asks for.
BLOCK_TYPES = {
    "TITLE": ["doc_title", "paragraph_title", "title", "sub_title", "chapter_title"],
    "TEXT": ["text", "abstract", "content", "reference", "reference_content", "algorithm", "figure_title", "table_title", "chart_title", "image_caption", "table_caption",
             "aside_text", "header", "footer", "footnote", "page_footnote", "number", "page_number", "formula_number"],
    "TABLE": ["table"],
    "FORMULA": ["formula", "display_formula", "inline_formula"],
    "VISION": ["image", "figure", "chart", "seal", "header_image", "footer_image"],
}


def block_type(label):
    """The type of a label, whatever its case and outer blanks; UNKNOWN for others and null."""
    name, out = F.lower(F.trim(label)), F.lit("UNKNOWN")
    for kind, labels in BLOCK_TYPES.items():
        out = F.when(name.isin(labels), kind).otherwise(out)
    return out


def containing_region(boxes: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """(by, box, region): the smallest region that holds the box's centre, edges included,
    else the one with the largest common area, else null.

    boxes: by, box, x0..y1; regions: by, region, r_x0..r_y1.
    """
    b, r = Box(), Box("r_")
    cx, cy = b.center
    met = boxes.join(regions, by, "left").withColumn("_in", F.coalesce(r.holds(cx, cy), F.lit(False))).withColumn("_common", b.common_area(r))
    order = W.partitionBy(*by, "box").orderBy(F.desc("_in"), F.when(F.col("_in"), r.area), F.desc("_common"), "region")
    best = met.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select(*by, "box", F.when(F.col("_in") | (F.col("_common") > 0), F.col("region")).alias("region"))


def attach_lines(lines: DataFrame, blocks: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by, line, block, share): the first block that holds most of a line, if it holds at
    least ``threshold`` of the line's area; block is null for an orphan."""
    share = Box().inside(Box("b_"))
    met = lines.join(blocks, by, "left").withColumn("share", F.coalesce(share, F.lit(0.0)))
    order = W.partitionBy(*by, "line").orderBy(F.desc("share"), "block")
    best = met.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    ok = F.col("share") >= threshold
    return best.select(*by, "line", F.when(ok, F.col("block")).alias("block"), F.round(F.when(ok, F.col("share")).otherwise(0.0), 6).alias("share"))


def orphan_groups(lines: DataFrame, by: list[str], factor: float = 1.6) -> DataFrame:
    """lines with ``island``: runs, in (y, x) order, where each line follows the one before
    by at most ``factor`` of its height and shares some width with it. Lines that start at one place under
    one number follow by their ends, so that islands don't depend on the order of the input."""
    order = W.partitionBy(*by).orderBy("y0", "x0", "line", "x1", "y1")
    before = Box(x0=F.lag("x0").over(order), y0=F.lag("y0").over(order), x1=F.lag("x1").over(order), y1=F.lag("y1").over(order))
    b = Box()
    follows = (b.y0 - before.y1 <= factor * before.height) & (b.overlap(before, "x") > 0)
    fresh = F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)
    return lines.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def island_boxes(groups: DataFrame, by: list[str]) -> DataFrame:
    return groups.groupBy(*by, "island").agg(F.count("*").alias("n_lines"), *union_of())


def widest_gap(boxes: DataFrame, by: list[str], axis: str = "y", least: float = 1.0) -> DataFrame:
    """(by, gap, cut_after): the widest stretch that no box crosses, over ``least`` wide,
    and the number of boxes before it. Boxes are walked by their start on the axis."""
    lo, hi = (axis + "0", axis + "1")
    order = W.partitionBy(*by).orderBy(lo, hi, "box")
    reach = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    gaps = boxes.withColumn("gap", F.col(lo) - reach).withColumn("cut_after", (F.row_number().over(order) - 1).cast("long"))
    best = W.partitionBy(*by).orderBy(F.desc("gap"), "cut_after")
    return gaps.where(F.col("gap") > least).withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*by, F.round("gap", 4).alias("gap"), "cut_after")


def gutter(words: DataFrame, by: list[str], candidates: int = 13, least_words: int = 40) -> DataFrame:
    """(by, gutter): the x position of 13 between 0.35 and 0.65 of the width that fewest
    words cross, if each side has a quarter of the words and at most 6 % cross.

    words: by, width, x0, x1. Ties go to the first position.
    """
    at = words.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    at = at.withColumn("g", F.round(F.col("width") * (0.35 + 0.3 * F.col("k") / (candidates - 1)), 4))
    n = at.groupBy(*by, "k", "g").agg(
        F.count("*").alias("n"), F.count_if((F.col("x0") < F.col("g")) & (F.col("x1") > F.col("g"))).alias("cross"), F.count_if(F.col("x1") <= F.col("g")).alias("left"), F.count_if(F.col("x0") >= F.col("g")).alias("right")
    )
    ok = n.where((F.col("n") >= least_words) & (F.col("left") * 4 >= F.col("n")) & (F.col("right") * 4 >= F.col("n")) & (F.col("cross") * 100 <= 6 * F.col("n")))
    best = W.partitionBy(*by).orderBy("cross", "k")
    return ok.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*by, F.col("g").alias("gutter"), "cross")


def cross_layout(boxes: DataFrame, by: list[str], factor: float = 1.3) -> DataFrame:
    """Boxes wider than ``factor`` medians that share width with at least two others."""
    wide = boxes.withColumn("_m", F.median(F.col("x1") - F.col("x0")).over(W.partitionBy(*by))).where((F.col("x1") - F.col("x0")) > factor * F.col("_m"))
    other = boxes.select(*by, *[F.col(c).alias("o_" + c) for c in ("box", "x0", "y0", "x1", "y1")])
    met = wide.join(other, by).where((F.col("box") != F.col("o_box")) & (Box().overlap(Box("o_"), "x") > 0))
    return met.groupBy(*by, "box").agg(F.count("*").alias("n_across")).where("n_across >= 2")


def aggregate_region_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, region, text, score): a region's lines from top to bottom, and their mean score."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda s: s["text"]), " ")
    return lines.groupBy(*by, "region").agg(text.alias("text"), F.round(F.avg("score"), 4).alias("score"))
