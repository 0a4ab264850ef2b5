"""URL filters: pattern rules indexed by their rarest literal token.

An address is a url after its first ``://``, its host (up to ``/``, ``?``, ``#`` or the end)
in lower case. Its tokens are the runs of ASCII letters and digits, in lower case. A rule has a
regular expression over addresses and the tokens that every address it fits must hold
whole. Of these the index keeps the one that the fewest addresses of the corpus hold, so an
address fetches few rules, and only those run their regular expression on it.

Of the rules that fit, the highest rank wins, then the longest, then allow, then the
first in order of its text. An address that no rule fits is allowed.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.plans.workspace import Workspace

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[a-z0-9]+"
#: Copies of a rule in the index, dealt by address, so that a frequent token isn't one task's.
SALTS = 16
#: Rules without a whole literal token run on every address; more than this are refused.
MOST_GENERIC = 256
#: An address on more than 1/HOT of all rows is joined by broadcast: at most HOT rows.
HOT = 1000
RULES = "rule string, verdict string, rank int, regex string, tokens array<string>"

#: The query's sites: host, path, verdict.
SITES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Patterns for addresses that no site rule fits.
PATTERNS = [
    ("^casino^", "block"),
    ("^poker^", "block"),
    ("^betting^", "block"),
    ("^pills^", "block"),
    ("^viagra^", "block"),
    ("^porn^", "block"),
    ("^xxx^", "block"),
    ("^spam^", "block"),
    ("^ads^track^", "block"),
    ("||adserver*.", "block"),
    ("^clicktrack", "block"),
    ("^spam^policy^", "allow"),
]


def site_rule(host: str, path: str, verdict: str, rank: int = 1) -> tuple:
    """Fits a host and all its subdomains where the url's path starts with ``path``."""
    if re.search("[?#]", path) or (path and path[0] != "/"):
        raise ValueError(f"not the start of a path: {path}")
    after = re.escape(path) or "(?=[/?#]|$)"
    return f"{host}{path}", verdict, rank, rf"^(?:[^/?#]*\.)?{re.escape(host)}{after}", _whole(host.lower() + path.lower(), True, not path)


def pattern_rule(pattern: str, verdict: str, rank: int = 0) -> tuple:
    """``*`` is any text, ``^`` one character that is no letter or digit, or either end of the
    address; ``||`` in front is the start of the host or of one of its labels, ``|`` in front or at the
    end that end of the address; all else stands for itself in either case."""
    body, head = pattern, ""
    if body.startswith("||"):
        head, body = r"^(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    tail = "$" if body.endswith("|") else ""
    body = body[: len(body) - len(tail)]
    parts = re.split(r"([*^])", body)
    regex = "".join({"*": ".*", "^": "(?:^|[^A-Za-z0-9]|$)"}.get(p, re.escape(p)) for p in parts)
    tokens, at_edge = [], bool(head)
    for i in range(0, len(parts), 2):
        closed = parts[i + 1] == "^" if i + 1 < len(parts) else bool(tail)
        tokens += _whole(parts[i].lower(), at_edge, closed)
        at_edge = i + 1 < len(parts) and parts[i + 1] == "^"
    return pattern, verdict, rank, f"(?is){head}{regex}{tail}", sorted(set(tokens))


def _whole(literal: str, open_edge: bool, close_edge: bool) -> list[str]:
    """Tokens of a literal that can't be part of a longer token of an address."""
    found = [(m.start(), m.end(), m.group()) for m in re.finditer(_TOKEN, literal)]
    return [t for a, b, t in found if (a > 0 or open_edge) and (b < len(literal) or close_edge)]


def default_rules() -> list[tuple]:
    return [site_rule(*s) for s in SITES] + [pattern_rule(*p) for p in PATTERNS]


def host_of(address: Column) -> Column:
    return F.regexp_extract(address, r"^[^/?#]*", 0)


def path_of(address: Column) -> Column:
    return F.regexp_extract(address, r"^[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """The url after its first ``://`` with a host in lower case; empty for null and other texts."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.concat(F.translate(host, _UPPER, _LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))), F.lit(""))


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(address, _UPPER, _LOWER), F.lit(_TOKEN), F.lit(0)))


def index_rules(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """``rules`` with ``token``: the rarest of each rule's tokens in ``addresses(address, n)``, of equal
    ones the first by text; null where a rule has none. Equal rules count once."""
    seen = addresses.select(F.explode(_tokens(F.col("address"))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    rules = rules.distinct()
    each = rules.select("*", F.explode_outer("tokens").alias("token")).join(seen, "token", "left")
    return each.groupBy(*rules.columns).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))


def decide(addresses: DataFrame, index: DataFrame) -> DataFrame:
    """(address, rule, rank, verdict) of each address in ``addresses(address)`` that a rule of the index fits."""
    generic = [r.asDict() for r in index.where("token is null").limit(MOST_GENERIC + 1).collect()]
    if len(generic) > MOST_GENERIC:
        raise ValueError(f"more than {MOST_GENERIC} rules without a whole literal token")
    deal = F.pmod(F.xxhash64("address"), F.lit(SALTS))
    keyed = index.where("token is not null").select("rule", "verdict", "rank", "regex", "token", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    some = addresses.select("address", deal.alias("salt"), F.explode(_tokens(F.col("address"))).alias("token")).join(keyed, ["token", "salt"])
    fits = some.where(F.expr("rlike(address, regex)")).select("address", "rule", "verdict", "rank")
    for g in generic:
        one = addresses.where(F.col("address").rlike(g["regex"]))
        fits = fits.union(one.select("address", F.lit(g["rule"]), F.lit(g["verdict"]), F.lit(g["rank"])))
    order = F.struct(-F.col("rank"), -F.length("rule"), F.col("verdict") != "allow", "rule", "verdict", "rank")
    return fits.groupBy("address").agg(F.min(order).alias("best")).select("address", "best.rule", "best.rank", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple = ("page_id",)) -> DataFrame:
    """Every row's kept columns, ``address``, and the winning ``rule``, its ``rank`` and ``verdict``
    (nulls where none fits). rules: see RULES, site_rule() and pattern_rule().

    Equal addresses are judged once. Null urls and those without ``://`` have an empty address. Rows
    stay apart, also with equal or null ids; other columns are ignored; an empty table gives an
    empty table, an empty rule list fits nothing. Very long urls are matched whole.
    """
    ws = Workspace(pages.sparkSession, "urls")
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), address_of(F.col(f"`{url}`")).alias("address"))
    keys = ws.table(held.groupBy("address").agg(F.count("*").alias("n")), "addresses")
    index = ws.table(index_rules(rules, keys), "index")
    best = ws.table(decide(keys, index), "decided")
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(keys.where(F.col("n") * HOT > total).select("address").join(best, "address", "left"))
    often = held.join(hot, "address")
    rest = held.join(hot.select("address"), "address", "left_anti").join(best, "address", "left")
    return often.unionByName(rest).select("kept.*", "address", "rule", "rank", "verdict")


def url_query(pages: DataFrame) -> DataFrame:
    """The contract's columns for every page, and ``pattern``: the pattern that decided where no
    site rule did. Cases as in judge()."""
    rules = pages.sparkSession.createDataFrame(default_rules(), RULES)
    found = judge(pages, rules)
    return found.select(
        "page_id",
        host_of(F.col("address")).alias("host"),
        path_of(F.col("address")).alias("path"),
        F.when(F.col("rank") == 1, F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("rank") == 0, F.col("rule")).alias("pattern"),
    )


def _sql_pattern(pattern: str) -> str:
    return pattern_rule(pattern, "")[3].replace("(?is)", "(?s)").replace("'", "''")


def url_sql() -> str:
    """The query for DuckDB: each rule's condition in turn, best first."""
    low = f"translate(%s, '{_UPPER}', '{_LOWER}')"
    sites = sorted(SITES, key=lambda s: (-len(s[0] + s[1]), s[2] != "allow", s[0] + s[1]))
    site = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = " ".join(f"WHEN {site(h, p)} THEN '{h}{p}'" for h, p, _ in sites)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in sites)
    pats = sorted(PATTERNS, key=lambda p: (-len(p[0]), p[1] != "allow", p[0]))
    pattern = " ".join(f"WHEN regexp_matches({low % 'address'}, '{_sql_pattern(p)}') THEN '{p}'" for p, _ in pats)
    by = " ".join(f"WHEN pattern = '{p}' THEN '{v}'" for p, v in pats)
    return rf"""WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {low % r"regexp_extract(rest, '^[^/?#]*')"} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  {low % r"regexp_extract(rest, '^[^/?#]*')"} || substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS address FROM r),
s AS (SELECT *, CASE {rule} END AS rule FROM h),
p AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {pattern} END END AS pattern FROM s)
SELECT page_id, host, path, rule, CASE {verdict} {by} ELSE 'allow' END AS verdict, pattern FROM p"""
