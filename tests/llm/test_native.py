"""Quality rules, decontamination, personal data and secrets against plain versions."""

import hashlib
import random
import re
import time

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioquery.llm import decontam, pii, quality, secrets, spans

sha = lambda xs: hashlib.sha256(",".join(xs).encode()).hexdigest()


def rows_of(edge):
    return [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def noisy(spark):
    """Texts of pieces that patterns are about."""
    random.seed(4)
    bits = ["a", "@", ".", "b.c", "-", " ", "\n", "1", "12", "255", "256", "+", "(", ")", "4111111111111111", "4111-1111 1111-1111", "é", "😀", "password", "token", "api_key", "API-KEY", ":", "=", "'", '"',
            "AKIA", "ABCDEFGHIJKL", "deadbeef" * 4, "0" * 31, "xyzXYZ99", "%", "_", "1.2.3.4", "+1 (555) 123-4567", "the", "fox"]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randrange(25)))) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "concat('s', doc_id % 7) AS source")


def test_quality_base(edge, noisy):
    for docs in (edge, noisy):
        want = sorted((brute.qual(t) for _, t in rows_of(docs)), key=str)
        got = quality.quality_query(docs).collect()
        assert sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
        assert not any(r.kept and r.base_failed for r in got)


def test_quality_repeat_windows(spark):
    line = "a b c d e f g h"
    texts = [line, line + " i", "a " * 9, "a " * 40, line + " x " + line, (line + " ") * 3, " ".join(map(str, range(60))) + " " + " ".join(map(str, range(10, 30)))]
    got = quality.quality_query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in got] == [brute.qual(t)[4] for t in texts]


def test_quality_model_finds_planted_junk():
    random.seed(1)
    rows: dict = {}
    for _ in range(4000):
        junk = random.random() < 0.15
        kind = random.randrange(3)
        v = tuple((-1 if junk and j == kind and random.random() < 0.95 else -1 if random.random() < 0.01 else 1 if random.random() < 0.8 else 0) for j in range(4))
        rows[v] = rows.get(v, 0) + 1
    model = quality.fit(list(rows.items()))
    import math

    assert abs(math.exp(model["log_prior"][0]) - 0.85) < 0.06
    assert all(a > 0.5 for a in model["accuracy"][:3])


def test_quality_posterior_is_that_of_the_model(edge, noisy):
    """The column's posterior against Bayes' rule written out, and the verdict by it."""
    import math

    for docs in (edge, noisy):
        names = [f"v_{n}" for n, *_ in quality.RULES]
        rows = quality.judge(docs).collect()
        patterns: dict = {}
        for r in rows:
            v = tuple(r[n] for n in names)
            patterns[v] = patterns.get(v, 0) + 1
        model = quality.fit(list(patterns.items()))
        for r in rows:
            joint = [math.exp(p + sum(rate[r[n]] for n, rate in zip(names, rates))) for p, rates in zip(model["log_prior"], model["log_rate"])]
            assert abs(r.quality - joint[0] / sum(joint)) < 1e-9
            assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_quality_filter_keeps_columns(read, edge):
    docs = read("documents")
    kept = quality.filter_quality(docs)
    assert kept.schema == docs.schema
    want = {r.doc_id for r in quality.quality_query(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.filter_quality(edge).columns == edge.columns
    good = read("labels").where("quality = 1").join(quality.quality_query(docs), "doc_id")
    assert good.where("kept or base_failed").count() >= 0.97 * good.count()


def test_quality_finds_labelled_junk(read):
    junk = read("labels").where("quality = 0").join(quality.quality_query(read("documents")), "doc_id")
    assert junk.where("not kept").count() >= 0.85 * junk.count()


@pytest.mark.parametrize("in_plan", [decontam.IN_PLAN, 0])
def test_decontamination(spark, edge, read, in_plan):
    item = "the quick brown fox jumps over the lazy dog while the patient old tortoise"
    bench = [(1, item), (2, "one two"), (3, None), (4, "..."), (5, "1"), (10, item.upper()), (10, item), (6, "zürich 漢字 😀 password"), (None, item)]
    table = spark.createDataFrame(bench, "item_id long, text string")
    for docs, b in ((edge, table), (read("documents"), read("benchmark")), (edge, table.limit(0))):
        items = [(r.item_id, r.text) for r in b.collect() if r.item_id is not None]
        want = sorted((str(brute.decon([(0, t)], items)[0]) for _, t in rows_of(docs)))
        got = decontam.scan(docs, b, in_plan=in_plan).collect()
        made = [str((r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), len(r["items"]) >= 2)) for r in got]
        assert sorted(made) == want
    kept = decontam.remove_contaminated(edge, table)
    assert kept.columns == edge.columns
    assert kept.count() == sum(not r.contaminated for r in decontam.decontam_query(edge, table).collect())


@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=14))
@settings(max_examples=15, deadline=None)
def test_decontamination_short_alphabet(spark, doc, item):
    docs, bench = [(0, " ".join(doc))], [(0, " ".join(item)), (1, "a b")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    r = decontam.decontam_query(d, b).first()
    assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute.decon(docs, bench)[0]


def test_pii(edge, noisy, read):
    for docs in (edge, noisy, read("documents")):
        want = sorted(sha(brute.pii(t)) for _, t in rows_of(docs))
        got = pii.pii_query(docs).collect()
        assert sorted(r.base_sha256 for r in got) == want
        for r in got:
            kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
            assert [kinds.count(k) for k in pii.BASE] == [r.n_email, r.n_ip, r.n_card, r.n_phone]


def test_pii_added_kinds_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 here", "IBAN DE88 3704 0044 0532 0130 00 here", "social security 078-05-1120", "part 078-05-1120", "visa 4111111111111111", "order 4111111111111111"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    found = [[(s.kind, s.score) for s in r.pii] for r in rows]
    assert found[0] == [("iban", 1.0)] and found[1] == []
    assert found[2] == [("ssn", 0.6)] and found[3] == []
    assert found[4][0][1] > found[5][0][1]


def test_pii_redact(spark, edge):
    docs = spark.createDataFrame([(1, "to a@b.cc now"), (2, None), (3, "none"), (4, "a@b.cc,1.2.3.4")], "doc_id long, text string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["to <email> now", None, "none", "<email>,<ip>"]
    assert pii.redact(edge).columns == edge.columns


def test_texts_with_very_many_matches(spark):
    """Work is near linear in a text's matches: these took minutes for a third of them."""
    n = 100_000
    docs = spark.createDataFrame([(1, " ".join(f"{i}@ex.org" for i in range(n))), (2, "no span"), (3, "ä " * 3000 + "to a@b.org, 10.0.0.1")], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in pii.pii_query(docs).select("doc_id", "n_email", "spans").collect()}
    assert time.time() - start < 30
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer("[^ ]+", docs.first().text))
    assert got[1].n_email == n and got[1].spans == want and got[3].spans == "email:6003:6010,ip:6012:6020"
    start = time.time()
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - start < 30
    assert red == {1: " ".join(["<email>"] * n), 2: "no span", 3: "ä " * 3000 + "to <email>, <ip>"}


def test_texts_with_very_many_secrets(spark):
    n = 20_000
    text = " ".join(f"token = value{i:08d}" for i in range(n)) + " token = value00000000"
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, "token = value00000001", "en", "b"), (3, None, "en", "c")], "doc_id long, text string, lang string, source string")
    start = time.time()
    got = {r.doc_id: r for r in secrets.secrets_query(docs).select("doc_id", "n_assign", "verdicts", "max_owners").collect()}
    assert time.time() - start < 60
    said = got[1].verdicts.split(",")
    assert got[1].n_assign == n + 1 == len(said) and said[1] == "live:2:2" and said[0] == said[-1] == "live:1:1" and got[2].verdicts == "live:2:2" and got[3].n_assign == 0


def test_running(spark):
    df = spark.createDataFrame([([3, 1, 2, 5, 4] * k,) for k in range(9)], "a array<int>")
    for r in df.select("a", spans.running(F.col("a"), lambda x, y: x + y).alias("s"), spans.running(F.col("a"), F.greatest).alias("m")).collect():
        assert r.s == [sum(r.a[: i + 1]) for i in range(len(r.a))] and r.m == [max(r.a[: i + 1]) for i in range(len(r.a))]
    t = "abcdé😀" * 1000
    one = spark.createDataFrame([(t,)], "t string").select(*[spans.cut(spans.blocks(F.col("t")), F.lit(i), F.lit(n)) for i, n in ((0, 5), (1020, 9), (1024, 0), (3000, 3000), (5999, 50))]).first()
    assert list(one) == [t[:5], t[1020:1029], "", t[3000:6000], t[5999:]]


def test_secrets(spark, edge, noisy, read):
    ascii_only = spark.createDataFrame([(1, "pa\u017f\u017fword = abcdefgh12 to\u212aen=abcdefgh12"), (2, "PassWord = abcdefgh12")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    for docs in (edge, noisy, read("documents"), ascii_only):
        got = secrets.secrets_query(docs).collect()
        want = [brute.sec(t) for _, t in rows_of(docs)]
        assert sorted(r.base_sha256 for r in got) == sorted(map(sha, want))
        kinds = lambda spans: tuple(sum(x.startswith(k + ":") for x in spans) for k in secrets.BASE)
        assert sorted((r.n_assign, r.n_access, r.n_hex) for r in got) == sorted(map(kinds, want))
        whole = sorted(",".join(brute.sec(t, added=True)) for _, t in rows_of(docs))
        assert sorted(r.spans for r in got) == whole
        assert all(len(r.verdicts.split(",")) == len(r.spans.split(",")) and r.n_live + r.n_example == (len(r.spans.split(",")) if r.spans else 0) for r in got)


def test_secrets_added_kinds(spark):
    texts = ["x ghp_" + "z1" * 18 + " y", "sk_live_" + "0Z" * 8, "xoxb-" + "1-a" * 7, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "-----BEGIN RSA PRIVATE KEY-----", "ghp_short sk_live_x xoxb-1 eyJa.b.c _ghp_" + "z1" * 18]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = [r.spans.split(":")[0] for r in secrets.secrets_query(docs).orderBy("doc_id").collect()]
    assert got == ["vendor", "vendor", "vendor", "jwt", "pem", ""]
    assert sorted(r.spans for r in secrets.secrets_query(docs).collect()) == sorted(",".join(brute.sec(t, added=True)) for t in texts)


def test_secret_owners(spark):
    shared, own = "password=example1234", "password=q8Zr7Lw2Kp"
    rows = [(i, f"x {shared} y", "en", f"owner{i}") for i in range(5)] + [(9, f"{own} {own} {shared}", "en", "owner1"), (10, own, "en", None), (11, own, "de", "owner1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: [(s.value, s.owners, s.repositories, s.live) for s in r.found] for r in secrets.scan(docs, "source", "concat_ws('/', source, lang)").collect()}
    a, b = ("example1234", 5, 5, False), ("q8Zr7Lw2Kp", 2, 3, True)
    assert got == {**{i: [a] for i in range(5)}, 9: [b, b, a], 10: [b], 11: [b]}
    r = secrets.secrets_query(docs).where("doc_id = 9").first()
    assert (r.n_example, r.n_live, r.max_owners, r.max_repositories, r.verdicts) == (1, 2, 5, 5, "live:2:3,live:2:3,example:5:5")


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert quality.quality_query(empty).count() == 0
    assert decontam.decontam_query(empty, none).count() == 0
    assert pii.pii_query(empty).count() == 0
    assert secrets.secrets_query(empty).count() == 0
    assert quality.filter_quality(empty).columns == empty.columns


def test_sql_twins(spark):
    import duckdb

    from folioquery.llm import queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, folder)
        want = con.sql(sql)
        pick = lambda cols, rows: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rows), key=str)
        assert pick(got.columns, got.collect()) == pick(want.columns, want.fetchall())
