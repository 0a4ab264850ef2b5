"""A view of a text in which marks and white space don't count, and the way back from a place
in the view to the place in the text.

A text is cut into pieces: escapes, which stand for one character of the view, and stretches of other
characters, of which the view leaves some out and keeps the rest in lower case. Lengths of the pieces
before a place in the view tell in which it lies, and only that one is looked through; no list of places is kept.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the view leaves out, escapes with what they stand for, and the most characters of a piece.
LEFT_OUT = " \t\r\n-*_`\"'“”‘’{}()[]|~^$\\"
ESCAPES = [
    (r"\times", "×"), (r"\%", "%"), (r"\$", "$"), (r"\&", "&"), (r"\#", "#"), (r"\_", "_"), (r"\cdot", "·"), (r"\pm", "±"),
    (r"\leq", "≤"), (r"\geq", "≥"), (r"\le", "≤"), (r"\ge", "≥"), (r"\ldots", "…"), (r"\dots", "…"),
]

_SET = "".join(f"\\x{{{ord(c):x}}}" for c in LEFT_OUT)
_ESCAPE = "(?:" + "|".join(e.replace("\\", "\\\\").replace("$", "\\$") for e, _ in sorted(ESCAPES, key=lambda e: -len(e[0]))) + ")"
STRETCH = 64
_PIECE = rf"{_ESCAPE}|\\|[^\\]{{1,{STRETCH}}}"
_RUN = f"[{_SET}]+|[^{_SET}]+"


def pieces(text: Column) -> Column:
    """array<struct<source, shown>>: the text in order; null is empty. Capitals whose small form differs
    by place or length keep one small form."""
    table = F.create_map(*[F.lit(x) for e in ESCAPES for x in e])
    plain = lambda p: F.lower(F.translate(p, "İΣ" + LEFT_OUT, "iσ"))
    shown = lambda p: F.when(p.startswith("\\"), F.coalesce(F.try_element_at(table, p), F.lit(""))).otherwise(plain(p))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0)), lambda p: F.struct(p.alias("source"), shown(p).alias("shown")))


def shown(pieces_: Column) -> Column:
    """The view, joined."""
    return F.array_join(F.transform(pieces_, lambda p: p["shown"]), "")


def view(text: Column) -> Column:
    return shown(pieces(text))


def find(view_: Column, needle: Column, first: Column | None = None, stop: Column | None = None) -> Column:
    """Place from 0 of a needle's view in a view, or in its part from ``first`` up to ``stop``; null if
    it isn't there, or nothing is left of the needle."""
    part = view_ if first is None else F.substring(view_, first + 1, stop - first)
    at = F.position(needle, part) - 1 + (F.lit(0) if first is None else first)
    return F.when((needle != "") & part.contains(needle), at)


def _kept(stretch: Column, nth: Column) -> Column:
    """Place in a stretch without escapes of the character that the view keeps there after ``nth`` others."""
    long = lambda n: F.lit(n).cast("long")

    def step(x, run):
        n = F.length(run).cast("long")
        kept = F.when(F.lit(LEFT_OUT).contains(F.left(run, F.lit(1))), long(0)).otherwise(n)
        at = F.when((x["at"] < 0) & (nth < x["v"] + kept), x["s"] + nth - x["v"]).otherwise(x["at"])
        return F.struct((x["v"] + kept).alias("v"), (x["s"] + n).alias("s"), at.cast("long").alias("at"))

    start = F.struct(long(0).alias("v"), long(0).alias("s"), long(-1).alias("at"))
    return F.aggregate(F.regexp_extract_all(stretch, F.lit(_RUN), F.lit(0)), start, step, lambda x: x["at"])


def source_span(pieces_: Column, at: Column, size: Column) -> Column:
    """struct<start, stop>: where ``size`` characters of the view from ``at`` lie in the text, from the
    first one's start to the last one's end; null where ``at`` is."""
    none = F.lit(None).cast("struct<nth: bigint, s: bigint, source: string>")
    start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("s"), none.alias("a"), none.alias("b"))

    def step(x, p):
        end = x["v"] + F.length(p["shown"])
        found = lambda c, at: F.when(x[c].isNull() & (at < end), F.struct((at - x["v"]).cast("long").alias("nth"), x["s"].alias("s"), p["source"].alias("source"))).otherwise(x[c])
        return F.struct(end.alias("v"), (x["s"] + F.length(p["source"])).alias("s"), found("a", at).alias("a"), found("b", at + size - 1).alias("b"))

    def span(x):
        escape = lambda c: x[c]["source"].startswith("\\")  # noqa: E731 its character is all of it
        first = F.when(escape("a"), F.lit(0).cast("long")).otherwise(_kept(x["a"]["source"], x["a"]["nth"]))
        stop = F.when(escape("b"), F.length(x["b"]["source"]).cast("long")).otherwise(_kept(x["b"]["source"], x["b"]["nth"]) + 1)
        return F.struct((x["a"]["s"] + first).alias("start"), (x["b"]["s"] + stop).alias("stop"))

    return F.when(at.isNotNull(), F.aggregate(pieces_, start, step, span))
