"""URL filters against a plain version; the SQL twin is tested with the others."""

import random
import re

import pytest
from folioquery.llm import url_filter as U

ODD = [None, "", "no scheme", "https://", "https://NET/", "https://net", "https://a.net/x", "http://notnet/", "x://Example.NET/en/A?b://c", "https://example.net/EN/", "https://m.example.com/de/1", "http://a.example.com/de", "https://x.org/fr/", "https://x.org?/fr/", "https://casino.example.com", "https://x.com/Casino/1", "https://x.com/casinos", "http://x.com/?q=cheap-pills", "http://ads-track.com/", "http://x.com/spam/policy/", "http://adserver77.x.com/", "http://x.com/adserver.", "http://clicktracker.com", "http://u@net:80/", "http://é.net/ü", "http://x.com/" + "a/" * 30_000 + "poker"]


def plain(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = m.group(1).translate({i: i + 32 for i in range(65, 91)})
    address = host + rest[len(host) :]
    best = None
    for rule, verdict, rank, regex, _ in rules:
        if re.search(regex, address, re.ASCII):
            key = (-rank, -len(rule), verdict != "allow", rule, verdict)
            best = min(best, key) if best else key
    return host, m.group(2), best[3] if best and best[0] else None, best[4] if best else "allow", best[3] if best and not best[0] else None


def as_rows(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) for r in df.collect()), key=str)


def test_equals_plain_version(spark):
    random.seed(1)
    bits = ["net", "org", "example", "com", "de", "casino", "pills", "Spam", "policy", "ads", "track", "poker", "x"]
    made = ["://" + "".join(random.choice(bits) + random.choice("./-?#_") for _ in range(random.randrange(1, 7))) for _ in range(800)]
    rows = [(i % 700 if i % 50 else None, u, "clash") for i, u in enumerate(ODD * 2 + made + ["http://hot.net/"] * 900)]
    df = spark.createDataFrame(rows, "page_id long, url string, address string")
    want = sorted(((i, *plain(u, U.default_rules())) for i, u, _ in rows), key=str)
    assert as_rows(U.url_query(df)) == want


def test_tokens_never_miss_a_match():
    random.seed(2)
    bits = ["ab", "c1", ".", "/", "-", "*", "^", "x"]
    text = lambda n: "".join(random.choice([b for b in bits if b not in "*^"]) for _ in range(random.randrange(n)))
    hits = 0
    for _ in range(4000):
        rule = U.pattern_rule(random.choice(["", "||", "|"]) + "".join(random.choice(bits) for _ in range(random.randrange(1, 5))) + random.choice(["", "|"]), "block")
        for address in (text(9), text(9)):
            if re.search(rule[3], address):
                hits += 1
                assert set(rule[4]) <= set(re.findall("[a-z0-9]+", address.lower())), (rule, address)
    assert hits > 500


def test_rarest_token_is_the_key(spark):
    pages = spark.createDataFrame([("often.rare/1", 5), ("often.other/rare", 1), ("often/2", 3)], "address string, n long")
    rules = spark.createDataFrame([U.pattern_rule("||often.rare^", "block"), U.pattern_rule("*x*", "block")], U.RULES)
    got = {r["rule"]: r["token"] for r in U.index_rules(rules, pages).collect()}
    assert got == {"||often.rare^": "rare", "*x*": None}


def test_rules_without_tokens_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/xyz"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([U.pattern_rule("y", "block")], U.RULES)
    assert {r["page_id"]: r["verdict"] for r in U.judge(pages, rules).collect()} == {1: "block", 2: None}
    assert U.judge(pages, rules.limit(0)).where("rule is not null").count() == 0
    assert U.url_query(pages.limit(0)).count() == 0
    many = spark.createDataFrame([U.pattern_rule(f"*{chr(97 + i % 26)}{i}*", "block") for i in range(U.MOST_GENERIC + 1)], U.RULES)
    with pytest.raises(ValueError):
        U.judge(pages, many)
