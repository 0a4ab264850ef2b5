"""Pattern spans with code-point offsets, in DataFrame functions only.

A pattern's matches and the texts between them come from two passes of the same
regular expression; running lengths give each match's place. Patterns are written so
that each position of a text is looked at a bounded number of times (possessive
repeats, look-behind at run starts), also in texts without white space.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters of a block of text.
BLOCK = 1024
_SPAN = "array<struct<kind:string,start:int,end:int,text:string>>"


def bound(value: Column, make) -> Column:
    """make(value) with the value computed once, however often it is named."""
    return F.transform(F.array(value), make)[0]


def running(values: Column, join) -> Column:
    """Running results of ``join`` (a sum, a maximum) over an array, each element included: over 2, then 4,
    8, .. neighbours, so the work is n log n and no array grows element by element."""

    def over(v):
        n = F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int")
        shifts = F.transform(F.sequence(F.lit(0), n), lambda k: F.call_function("shiftleft", F.lit(1), k))
        step = lambda a, d: F.when(F.size(a) <= d, a).otherwise(F.transform(a, lambda x, i: F.when(i < d, x).otherwise(join(x, F.get(a, i - d)))))
        return F.aggregate(shifts, v, step)

    return bound(values, over)


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK characters: a place far into it is then found without a walk to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks_: Column, start: Column, n: Column) -> Column:
    """``n`` characters from place ``start`` on, counted from 0."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + n) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks_, first + 1, last - first + 1), ""), (start - first * BLOCK + 1).cast("int"), n.cast("int"))


def find(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, start, end, text>> of leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = bound(found, lambda m: F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("g")))

    def placed(ps):
        ends = running(F.transform(ps, lambda p: F.length(p["g"]) + F.length(p["m"])), lambda x, y: x + y)
        one = lambda p, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(p["m"])).alias("start"), end.alias("end"), p["m"].alias("text"))
        return F.zip_with(ps, ends, one)

    return F.when(text.rlike(pattern), bound(pairs, placed).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def ordered(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by the kind's place in ``kinds``."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s.alias("span")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])), lambda x: x["span"])


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
