"""JSON, XML, HTML and LaTeX payloads as rows. Each payload is small; nesting needs a walk
of its own, one payload at a time on an executor."""

import html.parser
import json
import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ELEMENT = pa.struct([("seq", pa.int64()), ("parent_seq", pa.int64()), ("tag", pa.string()), ("attribs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
ELEMENTS = "array<struct<seq:bigint,parent_seq:bigint,tag:string,attribs:map<string,string>,text:string>>"
DEPTH = 24


def _tag(name) -> str:
    s = re.sub(r"[^A-Za-z0-9_.-]+", "_", str(name)).strip("_")
    return ("_" + s if s[:1].isdigit() or s[:1] in ".-" else s)[:64] or "element"


def _scalar(v) -> str:
    return "true" if v is True else "false" if v is False else str(v)


def json_elements(value, root: str = "document") -> list[dict]:
    """Elements of a JSON value in order: scalars are attributes, objects children, lists
    repeated children; nulls, empty strings and what is deeper than DEPTH are left out. An
    object with one member that is an object gives its name to the root."""
    if isinstance(value, dict) and len(value) == 1 and isinstance(next(iter(value.values())), dict):
        root, value = next(iter(value.items()))
    out: list[dict] = []

    def walk(tag, v, parent, depth):
        if depth > DEPTH or v is None or v == "":
            return
        own = {"seq": len(out), "parent_seq": parent, "tag": _tag(tag), "attribs": {}, "text": None}
        out.append(own)
        if isinstance(v, dict):
            for k, x in v.items():
                if isinstance(x, dict):
                    walk(k, x, own["seq"], depth + 1)
                elif isinstance(x, list):
                    for y in x:
                        walk(k, y, own["seq"], depth + 1)
                elif x is not None and x != "":
                    own["attribs"][str(k)] = _scalar(x)
        elif isinstance(v, list):
            for y in v:
                walk("item", y, own["seq"], depth + 1)
        else:
            own["text"] = _scalar(v)

    walk(root, value, None, 0)
    return out


def xml_elements(source: str) -> list[dict]:
    out: list[dict] = []

    def walk(node, parent):
        own = {"seq": len(out), "parent_seq": parent, "tag": _tag(node.tag), "attribs": dict(node.attrib), "text": (node.text or "").strip() or None}
        out.append(own)
        for child in node:
            walk(child, own["seq"])

    walk(ET.fromstring(source), None)
    return out


def first_json(text: str):
    """The first complete object or list in a text, as of a model's answer; None without."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text or ""):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def elements(docs: DataFrame, key: str, payload: str, kind: str) -> DataFrame:
    """(key, seq, parent_seq, tag, attribs, text) of payloads; kind: json (the first value in
    the text) or xml. A payload that can't be read gives no rows."""

    def one(text):
        try:
            return xml_elements(text) if kind == "xml" else [] if (v := first_json(text)) is None else json_elements(v)
        except ET.ParseError:
            return []

    def work(batches):
        for b in batches:
            got = [[{**e, "attribs": list(e["attribs"].items())} for e in one(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(_ELEMENT))], [key, "e"])

    made = docs.select(key, payload).mapInArrow(work, f"`{key}` {dict(docs.dtypes)[key]}, e {ELEMENTS}")
    return made.select(key, F.explode("e").alias("e")).select(key, "e.*")


class _Table(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.cells, self.row, self.open = [], -1, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.row += 1
        elif tag in ("td", "th"):
            span = lambda n: int(a[n]) if str(a.get(n, "")).isdigit() and int(a[n]) > 0 else 1
            self.open = {"row": max(self.row, 0), "header": tag == "th", "colspan": span("colspan"), "rowspan": span("rowspan"), "text": ""}
            self.cells.append(self.open)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open["text"] += data


def html_cells(source: str) -> list[dict]:
    """Cells of the first table in order, with their row, spans and header mark."""
    m = re.search(r"(?is)<table.*?</table>", source or "")
    if not m:
        return []
    p = _Table()
    p.feed(m.group())
    return [{**c, "text": " ".join(c["text"].split())} for c in p.cells]


def table_content(cells: list[dict], least_fill: float = 0.3) -> str | None:
    """A pipe table of cells without spans; None if fewer than ``least_fill`` of the body's
    cells are filled, or if cells are merged, where only the markup says it all."""
    rows: list[list[str]] = []
    for c in cells:
        while len(rows) <= c["row"]:
            rows.append([])
        rows[c["row"]].append(c["text"])
    body = [x for r in rows[1:] for x in r]
    if not rows or any(c["colspan"] > 1 or c["rowspan"] > 1 for c in cells) or (body and sum(map(bool, body)) / len(body) < least_fill):
        return None
    wide = max(map(len, rows))
    line = lambda r: "| " + " | ".join([x.replace("|", "\\|") for x in r] + [""] * (wide - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * wide, *map(line, rows[1:])])


def latex_cells(row: str) -> list[str]:
    """Cells of a table row: cut at ampersands outside braces that no backslash escapes."""
    out, depth, cell, i = [], 0, "", 0
    while i < len(row):
        c = row[i]
        if c == "\\" and i + 1 < len(row):
            cell += row[i : i + 2]
            i += 2
            continue
        depth += (c == "{") - (c == "}")
        if c == "&" and depth == 0:
            out.append(cell.strip())
            cell = ""
        else:
            cell += c
        i += 1
    return [*out, cell.strip()]


def macro_argument(text: str, macro: str) -> str | None:
    """The balanced argument of a macro's first use."""
    at = text.find("\\" + macro + "{")
    if at < 0:
        return None
    start = i = at + len(macro) + 2
    depth = 1
    while i < len(text) and depth:
        depth += (text[i] == "{" and text[i - 1] != "\\") - (text[i] == "}" and text[i - 1] != "\\")
        i += 1
    return text[start : i - 1] if depth == 0 else None
