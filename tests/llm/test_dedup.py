"""Near-duplicate documents and lines against plain versions; toxicity; the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquery.llm import line_dedup, near_dup, toxicity
from folioquery.llm.pipeline import STAGES, run


def shingle_sets(rows):
    out = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        out.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    return out


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def plain_clusters(rows, percent=85):
    sets, inverted, n = shingle_sets(rows), defaultdict(list), len(rows)
    parent, common = list(range(n)), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    for members in inverted.values():
        for i, a in enumerate(members):
            for b in members[:i]:
                common[b, a] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            parent[find(parent, a)] = find(parent, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(parent, i)] = min(low.get(find(parent, i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = low.get(find(parent, i), d)
        out.append((d, len(sets[i]), comp, d == comp))
    return out


def near_copies(seed, groups=12, most=30):
    random.seed(seed)
    rows, k = [], 0
    for g in range(groups):
        base = [random.choice("abcdefghijklm") + str(random.randrange(40)) for _ in range(random.choice([3, 8, 40, 120]))]
        for _ in range(random.randrange(1, most)):
            w = list(base)
            for _ in range(random.randrange(4)):
                w[random.randrange(len(w))] = "edit" + str(random.randrange(9))
            rows.append((k, " ".join(w)))
            k += 1
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [{}, {"list_block": 3, "set_block": 300}])
def test_near_duplicates(spark, blocks):
    rows = near_copies(1)
    got = [tuple(r) for r in near_dup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), **blocks).collect()]
    assert sorted(got) == sorted(plain_clusters(rows))
    assert len({r[2] for r in got}) < len(rows)


def test_near_duplicates_edge(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_dup_query(edge).collect()}
    want = set(plain_clusters([r for r in rows if r[0] is not None]))
    assert {g for g in got if g[0] is not None} == want
    assert [g[2:] for g in got if g[0] is None] == [(10, False)]
    kept = near_dup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({g[0] for g in want if g[3]})
    assert near_dup.near_dup_query(empty).count() == 0


def test_sketch_of_small_and_large_sets():
    import math

    for k in (1, 4, 16, 64):
        c = near_dup.needed(k)
        assert c == 1 or sum(math.comb(k, i) * 0.85**i * 0.15 ** (k - i) for i in range(c)) <= 1e-9
    assert len(near_dup.shingles("a b c")) == 1 and len(near_dup.shingles(" \n")) == 0 and len(near_dup.shingles(None)) == 0
    assert (near_dup.shingles("A b C d e f") == near_dup.shingles("a\tB c\nD E f")).all()
    assert (near_dup.shingles("É b") != near_dup.shingles("é b")).all()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@given(st.text("abé", max_size=40), st.text("abé", max_size=40), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_banded_distance(a, b, tau):
    assert line_dedup.within(a, b, tau) == (distance(a, b) <= tau)


@given(st.text("abcd", min_size=8, max_size=90), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 95), st.sampled_from("abxy")), max_size=3), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_keys_and_sketch_lose_no_link(a, edits, tau):
    b = list(a)
    for kind, at, c in edits[:tau]:
        at = min(at, len(b) - 1)
        if kind == 0:
            b.insert(at, c)
        elif kind == 1 and len(b) > 8:
            del b[at]
        else:
            b[at] = c
    b = "".join(b)
    assert line_dedup.within(a, b, tau)
    keys = lambda t, roles: {(s, t[i:j]) for s, i, j, r in line_dedup.windows(len(t), tau, 1) if r in roles}
    assert keys(a, {0}) & keys(b, {0, 1}) or keys(b, {0}) & keys(a, {0, 1})
    if min(len(a), len(b)) > 1:
        bits = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(line_dedup.parity(a), line_dedup.parity(b)))
        assert bits <= 4 * tau


def changed(words, edits):
    """The words with so many of them replaced, left out or put in."""
    w = list(words)
    for _ in range(edits):
        at, kind = random.randrange(len(w)), random.randrange(3)
        if kind == 0:
            w.insert(at, "new" + str(random.randrange(9)))
        elif kind == 1:
            del w[at]
        else:
            w[at] = "new" + str(random.randrange(9))
    return w


def test_word_keys_lose_no_link():
    random.seed(4)
    keys = lambda w, roles: {(s, tuple(w[i:j])) for s, i, j, r in line_dedup.windows(len(w), by_words=True, least=line_dedup.LONG) if r in roles}
    tried = 0
    for _ in range(150):
        a = [random.choice("abcdefgh") + str(random.randrange(30)) for _ in range(random.choice([50, 60, 119, 120, 161, 300, 420]))]
        b = changed(a, line_dedup.allowed(len(a)))
        tau = line_dedup.allowed(min(len(a), len(b)))
        if len(b) < line_dedup.LONG or not line_dedup.within(a, b, tau):
            continue
        tried += 1
        assert keys(a, {0}) & keys(b, {0, 1}) or keys(b, {0}) & keys(a, {0, 1})
        assert sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(line_dedup.parity(a), line_dedup.parity(b))) <= 4 * tau
    assert tried > 100


def test_word_distance():
    random.seed(5)
    for _ in range(150):
        a = [random.choice("abc") for _ in range(random.randrange(1, 90))]
        b = changed(a, random.randrange(min(14, len(a))))
        tau = random.randrange(1, 11)
        assert line_dedup.within(a, b, tau) == (distance(a, b) <= tau)


def test_keys_dealt_out_are_met(spark):
    random.seed(6)
    rows = [(k, "a common beginning of the line, then " + "".join(random.choice("abcdefgh") for _ in range(24))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    dealt = line_dedup._keys(docs, "text", 2, 24)
    want = defaultdict(set)
    for r in dealt.collect():
        want[r.key & ~1].add((r.key & 1, r.name & ~1))
    assert dealt.where("name & 1 > 0").count() >= 300
    want = {(k, n) for k, names in want.items() if len({n for _, n in names}) > 1 and any(not role for role, _ in names) for _, n in names}
    assert {tuple(r) for r in line_dedup._met(dealt).collect()} == want


def test_met_keys_pass_on_a_common_line_once(spark):
    """Each of many tasks sends the keys of the lines that all of them have."""
    lines = ["one line that is found in every document", "one lime that is found in every document"]
    docs = spark.createDataFrame([(k, "\n".join(lines)) for k in range(40)], "doc_id long, text string").repartition(40, "doc_id")
    met = line_dedup._met(line_dedup._keys(docs, "text", 2, 24))
    assert met.count() == met.distinct().count() > 0


def test_met_keys_grow_with_a_group(spark):
    """Lines that are all near each other: each has its own keys at most, whatever the group."""
    random.seed(22)
    made = []
    for n in (100, 200):
        rows = [(k, "a common line of a large group " + random.choice("abcdefgh") + f"{k:03d}") for k in range(n)]
        keys = line_dedup._keys(spark.createDataFrame(rows, "doc_id long, text string").repartition(20), "text", 2, 24)
        made.append(line_dedup._met(keys).count())
    assert made[0] > 100 and made[1] < 2.2 * made[0]


def near_lines(a, b, tau=2, least=24):
    """The measure of line_dedup, by plain rules."""
    if min(len(a), len(b)) < least:
        return False
    v, w = a.split(), b.split()
    most, both = line_dedup.LONG + line_dedup.SPARE, min(len(v), len(w))
    by_chars = max(len(v), len(w)) <= most and abs(len(a) - len(b)) <= tau and distance(a, b) <= tau
    return by_chars or (both >= line_dedup.LONG and abs(len(v) - len(w)) <= line_dedup.allowed(both) and distance(v, w) <= line_dedup.allowed(both))


def plain_lines(rows):
    """Each row's rest by the contract of drop_repeated_lines()."""
    lines = {}
    order = lambda d: (1 << 63) - 1 if d is None else d
    for d, t in rows:
        for x in (t or "").split("\n"):
            if x.strip():
                lines[x] = min(lines.get(x, order(d)), order(d))
    parent = {x: x for x in lines}
    bag = {x: Counter(x.split()) for x in lines}
    names = list(lines)
    for i, a in enumerate(names):
        for b in names[:i]:
            # lines of over 24 characters with few common words aren't near; spares the distance
            few = 2 * line_dedup.allowed(max(bag[a].total(), bag[b].total())) + 4
            if abs(bag[a].total() - bag[b].total()) <= few and ((bag[a] - bag[b]).total() <= few) and near_lines(a, b):
                parent[find(parent, a)] = find(parent, b)
    first = {}
    for x, d in lines.items():
        first[find(parent, x)] = min(first.get(find(parent, x), d), d)
    out = []
    for d, t in rows:
        seen, left, gone = set(), [], 0
        for x in (t or "").split("\n"):
            if x.strip():
                c = find(parent, x)
                if first[c] != order(d) or c in seen:
                    gone += 1
                    continue
                seen.add(c)
            left.append(x)
        if gone and not any(x.strip() for x in left):
            continue
        out.append((d, t if not gone else "\n".join(left)))
    return out


@pytest.mark.parametrize("blocks", [{}, {"key_block": 3, "class_block": 3}])
def test_repeated_lines(spark, edge, blocks):
    random.seed(9)
    bases = ["".join(random.choice("abcdefgh ") for _ in range(random.randrange(20, 60))) for _ in range(12)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(random.randrange(5)):
            line = list(random.choice(bases))
            for _ in range(random.randrange(4)):
                line[random.randrange(len(line))] = random.choice("xyz")
            text.append("".join(line))
        rows.append((k, "\n".join(text)))
    long = [[random.choice("abcdefgh") + str(random.randrange(30)) for _ in range(n)] for n in (49, 52, 70, 130, 200)]
    for k in range(60, 100):
        w = random.choice(long)
        rows.append((k, "\n".join([" ".join(changed(w, random.randrange(7))), random.choice(["All rights reserved.", "own line " + str(k), " \t"])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(length(text) as long) n_chars", "1 AS removed", "2 AS `left`")
    got = line_dedup.drop_repeated_lines(docs, **blocks)
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(plain_lines(rows))
    assert all(r.n_chars == len(r.text) for r in got)
    own = line_dedup.drop_repeated_lines(edge)
    assert sorted(((r.doc_id, r.text) for r in own.collect()), key=str) == sorted(plain_lines([(r.doc_id, r.text) for r in edge.collect()]), key=str)


def test_line_query(edge, empty):
    got = line_dedup.line_dedup_query(edge).collect()
    assert len(got) == edge.select("doc_id", "text").distinct().count()
    by = {r.doc_id: r for r in got}
    assert by[10].n_removed == 1 and by[10].first_doc == 5 and by[5].n_removed == 0 and by[1].n_lines == 0
    assert line_dedup.line_dedup_query(empty).count() == 0
    assert line_dedup.drop_repeated_lines(empty).columns == empty.columns


def toxic_corpus(spark, n=600):
    random.seed(11)
    words = ["".join(random.choice("bcdfgaeiou") for _ in range(random.randrange(3, 9))) for _ in range(300)]
    bad = ["awfulish", "nastyword", "grimstem" + "x"]
    rows, marks = [], []
    for k in range(n):
        w = [random.choice(words) for _ in range(random.randrange(20, 80))]
        y = k % 5 == 0
        if y:
            for _ in range(3):
                w[random.randrange(len(w))] = random.choice(bad[:2] + ["grimstem" + random.choice(words)])
        rows.append((k, " ".join(w)))
        marks.append((k, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    tagged = toxicity.tag(docs, model).join(labels, "doc_id").withColumn("held", toxicity.held_out(labels["doc_id"]))
    rows = [r for r in tagged.collect() if r.held]
    assert len(rows) > 60
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in rows) >= 0.97 * len(rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    hits = [text[r.doc_id][s.start : s.end] for r in rows for s in r.spans]
    assert hits and sum(h.startswith(("awful", "nasty", "grims")) for h in hits) >= 0.95 * len(hits)


def test_toxicity_marginals():
    field = toxicity.Field(["w:aa", "w:bb", "4:cccc"], np.array([3.0, -1.0, 2.0]), -2.5, np.array([[0.3, -0.7], [-0.2, 0.9]]))
    tagger = toxicity.Tagger(field)
    random.seed(5)
    for _ in range(200):
        words = [random.choice(["x", "y", "aa", "bb", "ccccdd"]) for _ in range(random.randrange(1, 14))]
        emit = np.array([[field.bias + sum(field.weight[c] for c in field.cues_of(w)) for w in words]])
        one, _ = toxicity._marginals(emit, field.move, np.ones(emit.shape, bool))
        for i, m in tagger.marginals(words):
            assert abs(m - one[0, i]) < 1e-9


def test_toxicity_edge(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 0), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_query(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.toxicity_query(edge, labels.limit(0)).count() == edge.count()
    assert toxicity.toxicity_query(empty, labels).count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    names = [n for n, _ in STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "benchmark_decontamination", "bpe_encoding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    step = docs
    for name, stage in STAGES[:-1]:
        new = stage(spark, step, folder)
        assert new.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in step.collect()]
        got = sorted((r.doc_id, r.text) for r in new.collect())
        if name == "line_dedup":
            assert got == sorted(plain_lines(rows))
        if name == "near_duplicates":
            keep = {d for d, _, _, k in plain_clusters(rows) if k}
            assert got == sorted(r for r in rows if r[0] in keep)
        assert {g[0] for g in got} <= {r[0] for r in rows}
        step = spark.createDataFrame(new.collect(), docs.schema)
    assert sorted(r.doc_id for r in run(spark, folder).collect()) == sorted(r.doc_id for r in step.collect())


def test_decontamination_stage_drops_one_item(spark):
    folder, stage = "/root/testdata/sf0.001", dict(STAGES)["benchmark_decontamination"]
    items = spark.read.parquet(f"{folder}/benchmark.parquet").where("size(split(text, ' ')) >= 8").orderBy("item_id").limit(2).collect()
    rows = [(1, "before it " + items[0].text + " and after"), (2, items[0].text + " " + items[1].text), (3, "nothing of the kind is in here at all, not a word of it")]
    assert [r.doc_id for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()] == [3]


def test_near_duplicates_stage_at_80(spark):
    rows = near_copies(1)
    got = {r.doc_id for r in dict(STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {d for d, _, _, k in plain_clusters(rows, 80) if k}
    assert got != {d for d, _, _, k in plain_clusters(rows, 85) if k}


def test_near_duplicates_keep_rows_without_id(spark):
    rows = [(1, "one of the two"), (1, "one of the two"), (None, "first text"), (None, "second text"), (2, "other")]
    got = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted({*rows}, key=str)


def test_unique_lines_stay(spark):
    line = "this one long line is found in both of the documents"
    rows = [(1, line), (2, line + "\nshort one\nshort two"), (3, line), (4, "short one")]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, line), (2, "short one\nshort two")]


def test_near_duplicates_tell_rows_apart(spark):
    rows = [(None, "text a"), (None, "text b"), (7, "text c"), (7, "text d"), (8, "text e"), (9, "text c"), (7, "text c")]
    got = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows[:5], key=str)


def test_near_copies_that_share_a_passage_with_many(spark):
    """A passage that every document holds, beside texts of their own, and near copies among them."""
    random.seed(21)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for k in range(150):
        own = [f"{k}x{random.randrange(10**6)}" for _ in range(random.choice([20, 60, 200]))]
        rows.append((3 * k, " ".join(own + passage)))
        if k % 5 == 0:
            w = own + passage
            w[random.randrange(len(w))] = "edit"
            rows.append((3 * k + 1, " ".join(w)))
            rows.append((3 * k + 2, " ".join(passage + own)))
    for percent in (80, 85):
        got = [tuple(r) for r in near_dup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, list_block=16).collect()]
        assert sorted(got) == sorted(plain_clusters(rows, percent))
