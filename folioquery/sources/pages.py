"""Pages of boxes: JSON files by manifest, detector output, and boxes in model text."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOX = "array<struct<text:string,label:string,bbox:array<double>,coordinate:array<double>,score:double,order:long>>"
GRANULARITIES = ("paragraph", "line", "word")


def granularities(asked: Column) -> Column:
    """The granularities asked for: all of them for ``all``, else the one."""
    return F.when(asked == "all", F.array(*map(F.lit, GRANULARITIES))).otherwise(F.array(asked))


def pick_granularity(preferred: Column, **boxes: Column) -> Column:
    """The granularity asked for if its list of boxes isn't empty, else the first that isn't,
    from words to paragraphs; null if all are empty."""
    some = {g: F.coalesce(F.size(b), F.lit(0)) > 0 for g, b in boxes.items()}
    return F.coalesce(*[F.when((preferred == g) & ok, g) for g, ok in some.items()], *[F.when(some[g], g) for g in reversed(GRANULARITIES) if g in some])


def read_pages(spark: SparkSession, folder: str, granularity: str = "paragraph") -> DataFrame:
    """(doc, page, width, height, boxes) of every document folder under ``folder`` that has a
    manifest.json (pages: page, dir); a page without its file is left out. A box without
    label is ``unlabeled``, one without text empty."""
    where = F.regexp_extract(F.input_file_name(), r"([^/]+)/manifest\.json$", 1)
    listed = spark.read.schema("pages array<struct<page:long,dir:string>>").option("multiLine", True).json(f"{folder}/*/manifest.json")
    listed = listed.select(where.alias("doc"), F.explode("pages").alias("p")).select("doc", "p.page", "p.dir")
    at = F.regexp_extract_all(F.input_file_name(), F.lit(r"([^/]+)/([^/]+)/[^/]+\.json$"), F.lit(0))[0]
    found = spark.read.schema(f"width double, height double, boxes {_BOX}").option("multiLine", True).json(f"{folder}/*/*/{granularity}.json")
    found = found.withColumn("_at", F.split(at, "/")).withColumn("doc", F.get("_at", F.lit(0))).withColumn("dir", F.get("_at", F.lit(1))).drop("_at")
    filled = F.transform(
        F.coalesce("boxes", F.array().cast(_BOX)),
        lambda b: F.struct(F.coalesce(b["text"], F.lit("")).alias("text"), F.coalesce(b["label"], F.lit("unlabeled")).alias("label"), F.coalesce(b["bbox"], b["coordinate"]).alias("bbox"), b["order"].alias("order")),
    )
    return listed.join(found, ["doc", "dir"]).select("doc", "page", "width", "height", filled.alias("boxes"))


def built(expected: DataFrame, present: DataFrame, by: list[str]) -> DataFrame:
    """(by, built): whether every expected file of a document is there. expected, present: by, file."""
    met = expected.join(present.select(*by, "file").distinct().withColumn("_ok", F.lit(True)), [*by, "file"], "left")
    return met.groupBy(*by).agg(F.bool_and(F.col("_ok").isNotNull()).alias("built"))


def regions(layout: Column) -> Column:
    """array<struct<label, score, bbox>> of a detector's JSON: boxes by ``coordinate`` or
    ``bbox`` to 2 places, those without either dropped, scores to 4 places."""
    read = F.from_json(layout, f"boxes {_BOX}")["boxes"]
    some = F.filter(F.coalesce(read, F.array().cast(_BOX)), lambda b: F.coalesce(b["coordinate"], b["bbox"]).isNotNull())
    return F.transform(some, lambda b: F.struct(b["label"].alias("label"), F.round(b["score"], 4).alias("score"), F.transform(F.coalesce(b["coordinate"], b["bbox"]), lambda v: F.round(v, 2)).alias("bbox")))


#: The two ways in which models mark boxes in text.
_MARK = r"<\|det\|>\s*(?:[A-Za-z][A-Za-z0-9_]*)?\s*\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]\s*<\|/det\|>"
_REF = r"(?s)<\|ref\|>.*?<\|/ref\|><\|det\|>.*?<\|/det\|>"
_TOKEN = r"<\|[^|>]*\|>"
_FOUND = "array<struct<label:string,text:string,grid:array<double>>>"


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _TOKEN, ""), F.lit(" \t\n\x0b\f\r"))


def grounded_boxes(raw: Column, width: Column, height: Column, refs_first: bool = True) -> Column:
    """struct(text, boxes) of a model's output: boxes as label, text, grid (0 to 999) and
    pixels (1 place). One dialect names a reference with a list of boxes; the other puts a
    mark before each block's text. The dialect asked for first wins if it has a box."""
    refs = F.regexp_extract_all(raw, F.lit(_REF), F.lit(0))

    def of_ref(m):
        label = F.trim(F.regexp_extract(m, r"(?s)<\|ref\|>(.*?)<\|/ref\|>", 1))
        grid = F.from_json(F.regexp_extract(m, r"(?s)<\|det\|>(.*?)<\|/det\|>$", 1), "array<array<double>>")
        four = F.filter(F.coalesce(grid, F.array().cast("array<array<double>>")), lambda g: F.size(g) == 4)
        return F.transform(four, lambda g: F.struct(label.alias("label"), F.lit(None).cast("string").alias("text"), g.alias("grid")))

    by_ref = F.flatten(F.transform(refs, of_ref)).cast(_FOUND)
    marks, bodies = F.regexp_extract_all(raw, F.lit(_MARK), F.lit(0)), F.split(raw, _MARK, -1)

    def of_mark(m, i):
        label = F.regexp_extract(m, r"<\|det\|>\s*([A-Za-z][A-Za-z0-9_]*)?", 1)
        grid = F.transform(F.regexp_extract_all(F.regexp_extract(m, r"\[(.*?)\]", 1), F.lit(r"(\d+)"), F.lit(1)), lambda v: v.cast("double"))
        return F.struct(F.when(label != "", label).otherwise("block").alias("label"), _plain(F.get(bodies, i + 1)).alias("text"), grid.alias("grid"))

    by_mark = F.transform(marks, of_mark).cast(_FOUND)
    text_ref = _plain(F.regexp_replace(raw, _REF, ""))
    text_mark = F.array_join(F.filter(F.transform(by_mark, lambda b: b["text"]), lambda t: t != ""), "\n\n")
    one, two = ((by_ref, text_ref), (by_mark, text_mark)) if refs_first else ((by_mark, text_mark), (by_ref, text_ref))

    def whole(text, found):
        pixels = lambda b: F.transform(b["grid"], lambda v, i: F.round(v / 999 * F.when(i % 2 == 0, width).otherwise(height), 1))
        return F.struct(text.alias("text"), F.transform(found, lambda b: F.struct(b["label"].alias("label"), b["text"].alias("text"), b["grid"].alias("grid"), pixels(b).alias("box"))).alias("boxes"))

    return F.when(F.size(one[0]) > 0, whole(one[1], one[0])).when(F.size(two[0]) > 0, whole(two[1], two[0])).otherwise(whole(_plain(raw), F.array().cast(_FOUND)))
