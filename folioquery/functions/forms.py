"""Short forms: cells, keys, captions, names of things, LaTeX sources, replies of models."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.functions.text import SPACE, clean_ws, snake, strip_comments, unescape_latex

#: No blank goes before or after these.
NO_SPACE_BEFORE, NO_SPACE_AFTER = list(",.;:!?)]}%"), list("([{$")
_WS = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_WS))


def as_text(c: Column, kind: str = "string") -> Column:
    """A scalar as text (true and false for booleans), a container (``kind`` struct, array or
    map) as JSON; null is empty."""
    return F.coalesce(F.to_json(c) if kind in ("struct", "array", "map") else c.cast("string"), F.lit(""))


def needs_space(before: Column, after: Column) -> Column:
    """Whether a blank goes between two words: not at an end of the text, before closing
    or after opening signs."""
    some = (F.coalesce(F.length(before), F.lit(0)) > 0) & (F.coalesce(F.length(after), F.lit(0)) > 0)
    return F.when(some, ~F.left(after, F.lit(1)).isin(NO_SPACE_BEFORE) & ~F.right(before, F.lit(1)).isin(NO_SPACE_AFTER)).otherwise(False)


def header_key(c: Column) -> Column:
    """Key from a table's header: LaTeX commands and punctuation to blanks, blanks to underscores."""
    s = F.regexp_replace(F.lower(strip(c)), r"\\[a-z]+", " ")
    s = strip(F.regexp_replace(s, r"[^\p{L}\p{N}_ \t\n\x0B\f\r]", " "))
    return F.regexp_replace(F.regexp_replace(s, SPACE, "_"), "^_+|_+$", "")


def slug(c: Column) -> Column:
    """Element name of a label: a-z and 0-9 in runs joined by underscores, ``f_`` before a
    digit at the start; null if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("f_"), s)).when(s != "", s)


def caption(c: Column) -> Column:
    """A form's caption without outer colons and dashes and without its section number."""
    s = strip(F.trim(clean_ws(c), F.lit(":—-–")))
    return F.regexp_replace(s, r"(?i)^SECTION[ \t]+[0-9]+[ \t]*[—–-][ \t]*", "")


def usable_caption(c: Column) -> Column:
    """3 characters or more, 4 words at most, a letter, no final period."""
    return (F.length(c) >= 3) & (F.size(F.split(clean_ws(c), " ")) <= 4) & c.rlike("[A-Za-z]") & ~c.endswith(".")


def phrase(c: Column) -> Column:
    return F.lower(F.trim(F.translate(c, "_-", "  ")))


def table_sourced(c: Column) -> Column:
    """Whether a source reference names a table (``T.3``)."""
    return F.upper(strip(F.coalesce(c, F.lit("")))).startswith("T.")


def fk_notation(child: Column, child_column: Column, parent: Column, parent_column: Column) -> Column:
    return F.format_string("%s.%s -> %s.%s", child, child_column, parent, parent_column)


def record_id(entity: Column, index: Column) -> Column:
    """``order_line-001`` for index 0."""
    return F.format_string("%s-%03d", snake(entity), (index + 1).cast("int"))


def document_stem(index: Column, root: Column, variant: Column, variants: Column) -> Column:
    """Document name from 0-based index and root record; a layout's number only if there are several."""
    stem = F.format_string("doc-%03d-%s", (index + 1).cast("int"), snake(root))
    return F.when(variants > 1, F.format_string("%s-v%d", stem, (variant + 1).cast("int"))).otherwise(stem)


def variant_clause(variant: Column, variants: Column) -> Column:
    """``layout 2 of 3``, counted from one and held in range; empty for a single layout."""
    at = F.least(F.greatest(variant, F.lit(0)), variants - 1) + 1
    return F.when(variants > 1, F.format_string("layout %d of %d", at.cast("int"), variants.cast("int"))).otherwise("")


def box_key(c: Column) -> Column:
    """struct(page, box) of ``page:box``, which sorts by number."""
    p = F.split(c, ":")
    return F.struct(p[0].cast("long").alias("page"), p[1].cast("long").alias("box"))


def eta(done: Column, todo: Column, seconds: Column) -> Column:
    """Seconds left at the pace so far; null before anything is done."""
    return F.when(done > 0, F.greatest(todo - done, F.lit(0)) * seconds / done)


def points_to_pixels(left: Column, bottom: Column, right: Column, top: Column, page_height: Column, scale: Column) -> list[Column]:
    """x0, y0, x1, y1 in pixels from the page's top, from points from its bottom."""
    return [left * scale, (page_height - top) * scale, right * scale, (page_height - bottom) * scale]


def rounded_box(*corners: Column, places: int = 2) -> Column:
    return F.array(*[F.round(c, places) for c in corners])


# LaTeX


def latex_document(c: Column) -> Column:
    """The document in a model's reply: the fenced part if it holds one, from the class line to
    the last end of the document, with a line end; null without both."""
    fence = F.coalesce(F.nullif(F.regexp_extract(c, r"(?is)```(?:la)?tex\s*?\n?(.*?)```", 1), F.lit("")), F.regexp_extract(c, r"(?s)```\s*?\n?(.*?)```", 1))
    body = F.when(fence.contains("\\documentclass"), fence).otherwise(strip(c))
    found = F.regexp_extract(body, r"(?s)\\documentclass.*\\end\{document\}", 0)
    return F.when(found != "", F.concat(strip(found), F.lit("\n")))


def layout_note(c: Column, most: int = 300) -> Column:
    """What a source's LAYOUT comment says, cut at ``most`` characters; null without one."""
    s = clean_ws(F.regexp_extract(c, r"(?im)^[ \t]*%+[ \t]*LAYOUT[ \t]*:[ \t]*(\S[^\n]*?)[ \t]*$", 1))
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most)), F.lit("..."))).when(s != "", s)


#: Fixed value: settings that keep LaTeX from hyphenating.
HYPHENATION_GUARD = "\\hyphenpenalty=10000\n\\exhyphenpenalty=10000\n\\emergencystretch=3em"


def harden(c: Column, guard: str = HYPHENATION_GUARD) -> Column:
    """The source with the guard before its body, unless it sets the penalty itself or has no body."""
    at = F.instr(c, "\\begin{document}")
    put = F.concat(F.left(c, at - 1), F.lit(guard + "\n\n"), F.substr(c, at))
    return F.when(c.contains("hyphenpenalty") | (at == 0), c).otherwise(put)


def comparable_latex(c: Column) -> Column:
    """A source as the text its page shows: no comments, breaks and ties to blanks, signs
    unescaped, font commands and braces gone, collapsed."""
    s = F.regexp_replace(strip_comments(c), r"\\\\\*?|\\(?:newline|linebreak|par|hfill|hspace|vspace|quad|qquad)\b", " ")
    s = F.regexp_replace(unescape_latex(s), r"\\(?:textbf|textit|texttt|emph|textsc|underline|mbox|textsl|textrm)[ \t\n]*\{", "")
    s = F.regexp_replace(s, r"~|\\,|\\ |[{}]", " ")
    return F.regexp_replace(s, SPACE, " ")


#: What may be put around a formula.
MATH_WRAPPERS = [("$$", "$$"), (r"\[", r"\]"), (r"\(", r"\)"), ("$", "$"), (r"\begin{equation*}", r"\end{equation*}"), (r"\begin{equation}", r"\end{equation}"), (r"\begin{displaymath}", r"\end{displaymath}")]


def strip_math(c: Column, most: int = 6) -> Column:
    """A formula without its fence and, up to ``most`` times, without wrappers around the whole."""
    s = strip(F.coalesce(c, F.lit("")))
    fence = F.regexp_extract(s, r"(?s)^```(?:latex|tex|math)?\s*?\n?(.*?)\n?```$", 1)
    s = F.when(s.rlike(r"(?s)^```.*```$"), strip(fence)).otherwise(s)

    def peeled(x):
        out = x
        for a, b in reversed(MATH_WRAPPERS):
            inside = strip(F.substr(x, F.lit(len(a) + 1), F.length(x) - len(a) - len(b)))
            out = F.when(x.startswith(a) & x.endswith(b) & (F.length(x) > len(a) + len(b)), inside).otherwise(out)
        return out

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), s, lambda x, _: peeled(x))


#: Accents, commands and signs of table cells and their plain text, in this order.
CELL_MARKS = [
    *[(r"\\\"\{%s\}" % a, b) for a, b in zip("aeiou", "äëïöü")],
    *[(r"\\'\{%s\}" % a, b) for a, b in zip("aeiou", "áéíóú")],
    (r"\\mathcal\{([A-Za-z])\}", "$1"),
    (r"\\mathbf\{([A-Za-z])\}", "$1"),
    (r"\\(?:emph|textbf|textit|texttt|text|url)\{", "{"),
    *[(r"\\%s(?![A-Za-z]) ?" % a, b) for a, b in (("times", "×"), ("pm", "±"), ("in", "∈"), ("sigma", "σ"), ("dagger", "†"), ("leq", "≤"), ("ldots", "..."))],
    (r"\\textsuperscript\{4\}", "⁴"),
    (r"\\S(?=[0-9])", "§"),
    *[(r"\\%s" % a, a) for a in "%&_#"],
    (r"\\\$", r"\$"),
    (r"\\\{", "\x01"),
    (r"\\\}", "\x02"),
    (r"\\,", ""),
    (r"\\;", " "),
    (r"\\ ", " "),
    ("---", "—"),
    ("--", "–"),
    ("``", '"'),
    ("''", '"'),
    (r"\^\{([^{}]*)\}", "^$1"),
    (r"_\{([^{}]*)\}", "_$1"),
]


def plain_cell(c: Column) -> Column:
    """A LaTeX table cell as the text that it shows, collapsed; escaped braces stay."""
    for mark, shown in CELL_MARKS:
        c = F.regexp_replace(c, mark, shown)
    c = F.translate(F.regexp_replace(c, r"[${}]", ""), "~\x01\x02", " {}")
    return clean_ws(c)


def log_errors(c: Column, shown: int = 3, most: int = 500) -> Column:
    """The first errors of a LaTeX log, each with the ``l.`` line of the three after it, and
    how many more there are; null without any."""
    lines = F.split(c, "\r?\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("! "), i)), lambda i: i.isNotNull())

    def said(i):
        after = F.filter(F.slice(lines, i + 2, 3), lambda x: x.startswith("l."))
        return strip(F.concat_ws(" ", strip(F.get(lines, i)), strip(F.coalesce(F.get(after, F.lit(0)), F.lit("")))))

    found = F.transform(at, said)
    more = F.when(F.size(found) > shown, F.format_string(" (+%d more)", F.size(found) - shown)).otherwise("")
    return F.when(F.size(found) > 0, F.left(F.concat(F.array_join(F.slice(found, 1, shown), "; "), more), F.lit(most)))


# Replies of models, as JSON texts


def reply_text(c: Column) -> Column:
    """The text of a reply in any of four shapes; empty without one."""
    paths = ["$.message.content", "$.choices[0].message.content", "$.choices[0].text", "$.response"]
    return F.coalesce(*[F.get_json_object(c, p) for p in paths], F.lit(""))


def reply_answer(c: Column) -> Column:
    """struct(answer, citations) of a JSON reply; any other reply is its own answer, citing
    the [n12] in it without quotes."""
    kind = "array<struct<id:string,quote:string>>"
    read = F.from_json(c, f"answer string, citations {kind}")
    ok = F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*\{") & ~F.coalesce(F.get_json_object(c, "$.citations"), F.lit("[]")).rlike(r"^[^\[]")
    inline = F.transform(F.regexp_extract_all(c, F.lit(r"\[(n[0-9]+)\]"), F.lit(1)), lambda x: F.struct(x.alias("id"), F.lit("").alias("quote")))
    good = F.filter(F.coalesce(read["citations"], F.array().cast(kind)), lambda x: x.isNotNull())
    return F.when(ok, F.struct(strip(F.coalesce(read["answer"], F.lit(""))).alias("answer"), good.alias("citations"))).otherwise(F.struct(c.alias("answer"), inline.cast(kind).alias("citations")))


def reply_rows(c: Column) -> Column:
    """array<string>: the JSON objects of a reply: a list, a list under one of five names (the
    first that holds a list), or a lone object."""
    none = F.array().cast("array<string>")
    listed = lambda path: F.from_json(F.when(F.get_json_object(c, path).startswith("["), F.get_json_object(c, path)), "array<string>")
    named = F.coalesce(*[listed(f"$.{k}") for k in ("records", "rows", "data", "instances", "items")])
    whole = F.when(strip(c).startswith("["), F.from_json(c, "array<string>"))
    lone = F.when(strip(c).rlike(r"(?s)^\{.*[^{\s].*\}$"), F.array(strip(c)))
    return F.filter(F.coalesce(whole, named, lone, none), lambda x: x.startswith("{"))


def clean_records(c: Column) -> Column:
    """array<struct<key, value, evidence, confidence>> of a reply's records that have a key and
    a value; other confidences than high, medium and low are medium."""
    rows = F.when(F.get_json_object(c, "$.records").startswith("{"), F.array(F.get_json_object(c, "$.records"))).otherwise(F.from_json(F.get_json_object(c, "$.records"), "array<string>"))

    def one(x):
        sure = F.lower(strip(F.coalesce(F.get_json_object(x, "$.confidence"), F.lit("medium"))))
        return F.struct(
            F.get_json_object(x, "$.key").alias("key"),
            F.get_json_object(x, "$.value").alias("value"),
            F.coalesce(F.get_json_object(x, "$.evidence"), F.lit("")).alias("evidence"),
            F.when(sure.isin("high", "medium", "low"), sure).otherwise("medium").alias("confidence"),
        )

    got = F.transform(F.coalesce(rows, F.array().cast("array<string>")), one)
    return F.filter(got, lambda r: r["key"].isNotNull() & r["value"].isNotNull())


# Blocks of a page


def lines_text(lines: Column) -> Column:
    """The texts of a block's lines that aren't empty, one a line."""
    return F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), "\n")


def pending_stub(kind: Column, step: Column, lines: Column) -> Column:
    """A marker for a block whose content is still to come, and its recognised text."""
    text = lines_text(lines)
    return F.concat(F.format_string("<!-- %s: pending %s -->", kind, step), F.when(text != "", F.concat(F.lit("\n"), text)).otherwise(""))


def block_text(content: Column, fallback: Column) -> Column:
    """A block's content, else its recognised text."""
    c = strip(F.coalesce(content, F.lit("")))
    return F.when(c != "", c).otherwise(strip(F.coalesce(fallback, F.lit(""))))


def provenance(block_id: Column, bbox: Column, status: Column, label: Column) -> Column:
    """XML attributes of a block, those that are there, each after a blank."""
    return F.concat(*[F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.format_string(' %s="%s"', F.lit(k), v.cast("string"))).otherwise("") for k, v in (("id", block_id), ("bbox", bbox), ("status", status), ("label", label))])


def charwise_noise(c: Column, percent: int, seed: int = 7, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """The text with about ``percent`` of its characters left out, changed (letters only) or
    doubled, by a hash of place and character, so that every run makes the same noise."""
    chars = F.split(c, "")

    def one(x, i):
        h = F.pmod(F.xxhash64(F.lit(seed), i, x), F.lit(10_000))
        kind = F.pmod(F.xxhash64(F.lit(seed + 1), i, x), F.lit(100))
        other = F.substr(F.lit(letters), F.pmod(F.xxhash64(F.lit(seed + 2), i, x), F.lit(len(letters))).cast("int") + 1, F.lit(1))
        changed = F.when(x.rlike(r"^\p{L}$"), other).otherwise(x)
        return F.when(h >= 100 * percent, x).when(kind < 34, "").when(kind < 67, changed).otherwise(F.concat(x, x))

    return F.array_join(F.transform(chars, one), "")
