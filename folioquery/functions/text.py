"""Column builders that bring text, names and values into comparable form.

Patterns use explicit ASCII classes, so that they mean the same in every SQL engine.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"


def clean_ws(c: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def norm_alnum(c: Column) -> Column:
    """Lower case; runs of all but a-z and 0-9 to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def norm_content(c: Column) -> Column:
    """Markup tags dropped, letters and digits of any script kept, lower case, collapsed."""
    return F.lower(clean_ws(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[^\p{L}\p{N} \t\n\x0B\f\r]", " ")))


def fold_marks(c: Column) -> Column:
    """Curly quotes, dashes and soft hyphens to their plain forms, lower case, collapsed."""
    return F.lower(clean_ws(F.translate(F.translate(c, "­", ""), "‘’‚“”„–—−", "'''\"\"\"---")))


def snake(c: Column, default: str = "field") -> Column:
    """Identifier: camel humps and other characters to single underscores, lower case; ``n``
    before a digit at the start."""
    s = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "[^0-9a-zA-Z]+", "_")
    s = F.lower(F.regexp_replace(s, "^_+|_+$", ""))
    s = F.when(s.rlike("^[0-9]"), F.concat(F.lit("n"), s)).otherwise(s)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def pascal(c: Column, default: str = "Entity") -> Column:
    s = F.regexp_replace(F.initcap(F.translate(snake(c, ""), "_", " ")), " ", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def humanize(c: Column) -> Column:
    return F.initcap(F.trim(F.translate(c, "_", " ")))


def norm_key(c: Column) -> Column:
    """Key name: lower case; white space, hyphens and underscores to one underscore, none at
    the ends. Other characters stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r_-]+", "_"), "^_+|_+$", "")


def _unless_empty(new: Column, old: Column) -> Column:
    return F.when(new == "", old).otherwise(new)


CITATION = r"[ \t\n\x0B\f\r]*\[[0-9]+(,[ \t\n\x0B\f\r]*[0-9]+)*\]"
#: Signs that values write in several ways.
SIGNS = [("×", "x"), ("−", "-"), ("–", "-"), ("—", "-"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("±", "+-"), ("≤", "<="), ("≥", ">="), ("∈", " in "), ("\u00a0", " ")]


def nfkc(c: Column) -> Column:
    """Compatibility form of Unicode. ASCII texts keep to the JVM's side of the batch as they are."""
    import unicodedata

    import pandas as pd

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return form(c)


def norm_value(c: Column, compose: bool = True) -> Column:
    """Comparable value: compatibility form, signs folded, lower case, collapsed; outer quotes
    go, citation brackets unless nothing else is left, then a final period and, with
    something before it, a percent sign. Null is empty."""
    s = F.coalesce(c, F.lit(""))
    s = nfkc(s) if compose else s
    for a, b in SIGNS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(F.lower(clean_ws(s)), "^[\"']+|[\"']+$", "")
    s = _unless_empty(F.trim(F.regexp_replace(s, CITATION, "")), s)
    s = F.trim(F.regexp_replace(s, r"\.$", ""))
    return F.when(s.endswith("%"), _unless_empty(F.trim(F.regexp_replace(s, "%$", "")), s)).otherwise(s)


def norm_entity(c: Column) -> Column:
    """Lower case, collapsed, without citation brackets unless nothing else is left."""
    s = F.lower(clean_ws(F.coalesce(c, F.lit(""))))
    return _unless_empty(F.trim(F.regexp_replace(s, CITATION, "")), s)


def canon_value(c: Column) -> Column:
    """Lower case, punctuation to blanks, a leading article dropped."""
    return F.regexp_replace(norm_alnum(c), "^(a|an|the) ", "")


def words_of(c: Column) -> Column:
    """Words of normalised text; none for an empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def word_set(c: Column, least: int = 3) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm_alnum(c), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))


def xml_safe(c: Column) -> Column:
    """Characters that XML 1.0 forbids are dropped."""
    return F.regexp_replace(c, r"[^\x09\x0A\x0D\x20-퟿-�\x{10000}-\x{10FFFF}]", "")


def xml_escape(c: Column) -> Column:
    s = F.replace(F.replace(F.replace(xml_safe(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(s, F.lit('"'), F.lit("&quot;"))


def xml_tag(c: Column, default: str = "element") -> Column:
    """A legal XML name of at most 64 characters."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    s = F.when(s.rlike("^[^A-Za-z_]"), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(F.substring(s, 1, 64))


def sql_ident(c: Column, default: str = "value") -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    s = F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"-[ \t]*\n[ \t]*", "")


def escape_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def strip_comments(c: Column) -> Column:
    """Unescaped percent comments up to their line's end."""
    return F.regexp_replace(c, r"(?<!\\)%[^\n]*", "")


_LATEX = [("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")]


def escape_latex(c: Column) -> Column:
    """The ten reserved characters, each once, character by character; null is empty."""
    table = F.create_map(*[F.lit(x) for pair in _LATEX for x in pair])
    chars = F.split(F.coalesce(c, F.lit("")), "")
    return F.array_join(F.transform(chars, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def unescape_latex(c: Column) -> Column:
    for plain, out in _LATEX[1:] + _LATEX[:1]:
        c = F.replace(c, F.lit(out), F.lit(plain))
    return c


def first_table(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<table.*?</table>", 0)


def bare_label(c: Column) -> Column:
    """A tagger's label without its B-, I-, E- or S- prefix."""
    return F.regexp_replace(c, "^[BIES]-", "")


def hms(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.format_string("%dh%02dm", hours, minutes)).when(s >= 60, F.format_string("%dm%02ds", minutes, rest)).otherwise(F.format_string("%ds", rest))


def node_kind(text: Column, is_heading: Column) -> Column:
    """Kind of a passage by its surface: heading, image, formula, table, marker (under four
    characters once folded) or prose."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return (
        F.when(is_heading, "heading")
        .when(t.startswith("!["), "image")
        .when(t.startswith("$"), "formula")
        .when(t.startswith("|") | t.contains("| --- |"), "table")
        .when(F.length(fold_marks(t)) < 4, "marker")
        .otherwise("prose")
    )


def is_atomic(c: Column, most: int = 4) -> Column:
    return F.size(words_of(clean_ws(c))) <= most


def as_bool(c: Column, default: bool | None = False) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1", "yes", "y", "t"), True).when(s.isin("false", "0", "no", "n", "f"), False).otherwise(F.lit(default))


def clamp01(c: Column, default: float) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.expr("null") if c is None else c.try_cast("double"))), F.lit(default))


def positive_int(c: Column, default: int = 1) -> Column:
    n = c.try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))


def reference_parts(c: Column) -> Column:
    """struct(entity, column) of ``Entity.column``, cut at the first separator."""
    return F.struct(F.trim(F.regexp_extract(c, r"^([^.:/#\[(]+)", 1)).alias("entity"), F.trim(F.regexp_extract(c, r"^[^.:/#\[(]+[.:/#\[(]([^\])]*)", 1)).alias("column"))


def parse_relationship(c: Column) -> Column:
    """struct(child, child_column, parent, parent_column) of ``Child.col -> Parent.col``."""
    sides = F.split(c, r"\s*(->|=>|→)\s*", 2)
    a, b = reference_parts(sides[0]), reference_parts(F.get(sides, F.lit(1)))
    return F.struct(a["entity"].alias("child"), a["column"].alias("child_column"), b["entity"].alias("parent"), b["column"].alias("parent_column"))


#: Names of types as they come, and the 15 semantic types that they stand for.
PRIMITIVE_TYPES = ["string", "text", "integer", "decimal", "currency", "percent", "boolean", "date", "datetime", "email", "phone", "url", "address", "id", "enum"]
TYPE_ALIASES = {
    "str": "string", "varchar": "string", "char": "string", "name": "string",
    "int": "integer", "int64": "integer", "number": "integer", "bigint": "integer", "smallint": "integer", "serial": "integer",
    "float": "decimal", "double": "decimal", "numeric": "decimal", "real": "decimal",
    "money": "currency", "amount": "currency", "price": "currency", "usd": "currency", "cad": "currency",
    "bool": "boolean", "flag": "boolean",
    "timestamp": "datetime", "time": "datetime", "datetime2": "datetime",
    "e-mail": "email", "email_address": "email",
    "telephone": "phone", "tel": "phone", "phone_number": "phone",
    "uri": "url", "link": "url", "website": "url",
    "postal_address": "address", "location": "address",
    "uuid": "id", "guid": "id", "identifier": "id", "pk": "id", "fk": "id", "foreign_key": "id", "primary_key": "id", "reference": "id",
    "category": "enum", "choice": "enum", "status": "enum",
    "longtext": "text", "description": "text", "notes": "text",
}


def semantic_type(c: Column) -> Column:
    """struct(type, known): the type that a name stands for, by its identifier form or that
    form's first word; string otherwise."""
    table = F.create_map(*[F.lit(x) for k, v in (TYPE_ALIASES | {p: p for p in PRIMITIVE_TYPES}).items() for x in (k, v)])
    whole = snake(F.trim(c), "")
    found = F.coalesce(F.try_element_at(table, whole), F.try_element_at(table, F.split_part(whole, F.lit("_"), F.lit(1))))
    return F.struct(F.coalesce(found, F.lit("string")).alias("type"), found.isNotNull().alias("known"))
