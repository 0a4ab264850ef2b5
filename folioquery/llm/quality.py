"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes junk (-1), good (+1) or abstains (0) on a document's surface
features. The votes of all documents are counted by pattern; expectation-maximisation
over those counts estimates how often each rule casts each vote on good and on junk
documents. A document is kept when its posterior probability of being good is at least
``threshold``.

Number of patterns: at most 3 ** len(RULES), whatever the number of documents; only
those counts reach the driver.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.plans.workspace import Workspace

#: (name, junk condition, good condition) over the feature columns; junk is asked first.
RULES = [
    ("length", "n_words < 20", "n_words >= 60"),
    ("word_length", "word_chars > 14 * n_words or 2 * word_chars < 5 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("repeats", "100 * n_repeat_words > 30 * n_words", "n_repeat_words = 0"),
    ("dup_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    ("capitals", "10 * n_upper > 3 * word_chars", "20 * n_upper <= 3 * word_chars"),
    ("exclaim", "5 * n_exclaim > n_words", "n_exclaim = 0"),
    ("stutter", "5 * n_same > n_words", "20 * n_same <= n_words"),
]

_SPACE = "\t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _repeat_words(words: str, size: int) -> str:
    """SQL: words of array ``words`` that lie in windows of ``size`` found twice or more.

    Windows are compared by a 64-bit hash of their words' hashes, within one text.
    """
    window = ", ".join(f"get(h, i + {k})" for k in range(size))
    return f"""
    case when size({words}) <= {size} then 0L else
      transform(array(transform({words}, x -> xxhash64(x))), h ->
        transform(array(transform(sequence(0, size(h) - {size}), i -> xxhash64({window}))), g ->
          case when size(array_distinct(g)) = size(g) then 0L else
            transform(array(sort_array(transform(g, (x, i) -> struct(x as x, i as i)))), s ->
              aggregate(
                sort_array(transform(
                  filter(s, (e, k) -> (k > 0 and get(s, k - 1).x <=> e.x) or get(s, k + 1).x <=> e.x),
                  e -> e.i)),
                struct(-{size} as last, 0L as n),
                (a, i) -> struct(i as last, a.n + least({size}, i - a.last) as n),
                a -> a.n))[0]
          end)[0])[0]
    end"""


def features(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The kept columns and the counts that the rules use; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    flat = F.translate(t, _SPACE, " " * len(_SPACE))
    gone = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    out = docs.select(
        *keep,
        (F.length(t) - gone(" " + _SPACE)).cast("long").alias("word_chars"),
        gone("#*$%&|<>").alias("n_symbols"),
        gone(_UPPER).alias("n_upper"),
        gone("!").alias("n_exclaim"),
        F.filter(F.split(flat, " "), lambda w: w != "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, _SPACE, " " * len(_SPACE))) != "").alias("_l"),
    )
    return out.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("_w", 8)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.expr("size(filter(_w, (x, i) -> x = get(_w, i - 1)))").cast("long").alias("n_same"),
        "n_upper",
        "n_exclaim",
    ).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def votes(features: DataFrame, rules=RULES) -> DataFrame:
    cols = [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").cast("int").alias(f"v_{name}") for name, bad, good in rules]
    return features.select("*", *cols)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, smooth: float = 0.05, anchor: float = 0.999) -> dict:
    """EM over vote patterns with their counts.

    Documents come from one good kind or from one junk kind for each rule, as junk is
    of several sorts that few rules see at once. Votes are independent given the kind.
    Junk kind j is tied to its rule by P(rule j votes junk | kind j) >= ``anchor``; all
    other rates, and how common each kind is, are estimated. Starts from the patterns
    with a junk vote (mostly junk) and without (mostly good).

    Returns ``log_prior`` by kind (0 is good), ``log_rate[kind][rule][vote]`` and
    ``accuracy`` by rule: the estimated share of junk among its junk votes.
    """
    patterns = sorted(patterns)
    if not patterns:
        return {"log_prior": [0.0], "log_rate": [[]], "accuracy": []}
    k = len(patterns[0][0])
    shares = []
    for v, _ in patterns:
        bad = [j for j in range(k) if v[j] == -1]
        first = 0.05 if bad else 0.98
        shares.append([first] + [(1 - first) * ((j in bad) / len(bad) if bad else 1 / k) for j in range(k)])
    for _ in range(rounds):
        mass = [sum(p[z] * c for p, (_, c) in zip(shares, patterns)) for z in range(k + 1)]
        whole = sum(mass) + (k + 1) * smooth
        log_prior = [math.log((m + smooth) / whole) for m in mass]
        log_rate = []
        for z in range(k + 1):
            rows = []
            for j in range(k):
                n = dict.fromkeys((-1, 0, 1), smooth)
                for p, (v, c) in zip(shares, patterns):
                    n[v[j]] += p[z] * c
                rate = {a: x / sum(n.values()) for a, x in n.items()}
                if z == j + 1 and rate[-1] < anchor:
                    rest = rate[0] + rate[1]
                    rate = {-1: anchor, 0: (1 - anchor) * rate[0] / rest, 1: (1 - anchor) * rate[1] / rest}
                rows.append({a: math.log(x) for a, x in rate.items()})
            log_rate.append(rows)
        new = []
        for v, _ in patterns:
            logs = [log_prior[z] + sum(log_rate[z][j][v[j]] for j in range(k)) for z in range(k + 1)]
            top = max(logs)
            e = [math.exp(x - top) for x in logs]
            new.append([x / sum(e) for x in e])
        moved = max(abs(a[0] - b[0]) for a, b in zip(new, shares))
        shares = new
        if moved < 1e-9:
            break
    accuracy = []
    for j in range(k):
        cast = [(1 - p[0], c) for p, (v, c) in zip(shares, patterns) if v[j] == -1]
        n = sum(c for _, c in cast)
        accuracy.append(sum(p * c for p, c in cast) / n if n else None)
    return {"log_prior": log_prior, "log_rate": log_rate, "accuracy": accuracy}


def posterior(model: dict, names: list[str]):
    """Column: probability of the good kind given the vote columns."""
    logs = []
    for first, rates in zip(model["log_prior"], model["log_rate"]):
        x = F.lit(first)
        for name, w in zip(names, rates):
            x = x + F.when(F.col(name) == -1, w[-1]).when(F.col(name) == 1, w[1]).otherwise(w[0])
        logs.append(x)
    total = F.lit(0.0)
    for x in logs:
        total = total + F.exp(x - logs[0])
    return F.lit(1.0) / total


def judge(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row a document: kept columns, features, votes, ``quality`` (posterior), ``kept``.

    A null or empty text has no words, fails the base rule and isn't kept. Repeated
    rows are judged alike, one output row each. An empty table gives an empty table.
    """
    ws = Workspace(docs.sparkSession, "quality")
    rows = ws.table(votes(features(docs, text, keep), rules), "votes")
    names = [f"v_{name}" for name, *_ in rules]
    counts = rows.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    model = fit([(tuple(r[n] for n in names), r["count"]) for r in counts])
    out = rows.withColumn("quality", posterior(model, names))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality_query(docs: DataFrame) -> DataFrame:
    """The contract's columns and the posterior; cases as in judge()."""
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judge(docs).select(*cols)


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; null and empty texts go."""
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(text).alias("text"))
    judged = judge(packed, keep=("row",)).where("kept")
    return judged.select(*[F.col("row")[c].alias(c) for c in cols])
