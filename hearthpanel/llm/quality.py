"""Quality rules and robust multivariate outliers.

Every text gets counts; a base rule rejects texts that are too short or repeat themselves. The counts of
the others become a vector of logarithms (``STATISTICS``). Per language and source the minimum covariance
determinant estimates centre and spread of the vectors from the ``SHARE`` of documents that lie closest
together; a document whose Mahalanobis distance is beyond the ``CUTOFF`` quantile of the chi-square
distribution is rejected.

The estimate starts from medians and quartile ranges and repeats concentration steps: distances under the
present estimate, then mean and covariance of the closest documents. A step is one grouping by language,
source and distance bin with sums of products, so no group is ever gathered or sorted; the closest
documents are whole bins. Vectors are rounded to 1/256, which makes all sums exact and reruns equal.

Every statistic has a least spread (``LEAST_SPREAD``): where most texts of a group agree exactly, small
departures are no outliers. An estimate is drawn to that of the language over all sources, and this to that of
all documents, with the weight of ``PRIOR_ROWS`` documents, so groups of any size are judged by one rule. Null texts count as empty, null languages and sources are groups of their own, repeated rows get
equal results, an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.llm.common import SPACE, WORD, pick
from hearthpanel.operators.keyed import attach, null_safe_join
from hearthpanel.workspace import materialize

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"
STATISTICS = ("size", "word_length", "symbols", "duplicate_lines", "repeats")
LEAST_SPREAD = (0.3, 0.1, 0.35, 0.35, 0.35)
SHARE = 0.75
STEPS = 5
CUTOFF = 0.99999
LEAST_ROWS = 40
PRIOR_ROWS = 40
_GRID = 256
_P = len(STATISTICS)


def chi_square(x: float, degrees: int) -> float:
    """Cumulative probability for an odd number of degrees."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for k in range(1, degrees - 1, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return low


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` (with text) with the base counts n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and n_lines, without the text."""
    kept = [c for c in rows.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x))
    read = rows.select(
        *kept,
        F.transform(words, lambda w: F.xxhash64(w)).alias("_words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    window = lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(WINDOW)])
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window))
    read = read.select(
        *kept, "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # Most texts repeat no window; only the others sort theirs.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    read = read.withColumn("_sorted", F.when(repeats, F.sort_array(placed))).drop("_windows")
    same = lambda x, k: (x.h == F.get("_sorted", k - 1).h) | (x.h == F.get("_sorted", k + 1).h)
    twice = F.filter("_sorted", lambda x, k: F.coalesce(same(x, k), F.lit(False)))
    read = read.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x.i))).drop("_sorted")
    # Words covered: each window adds what lies before the next one.
    step = lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - x, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("_places", step), F.lit(0).cast("long"), lambda a, b: a + b)
    return read.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1)).cast("double")
    chars = F.greatest("word_chars", F.lit(1)).cast("double")
    values = [
        F.log(words),
        F.log(chars / words),
        F.log1p(100.0 * F.col("n_symbols") / chars),
        F.log1p(10.0 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.log1p(10.0 * F.col("n_repeat_words") / words),
    ]
    return [F.rint(v * _GRID) for v in values]


def _start(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Per group medians and squared quartile ranges as first centre and diagonal spread."""
    cells = vectors.select(*keys, F.posexplode("x").alias("k", "v")).groupBy(*keys, "k", "v").agg(F.count(F.lit(1)).alias("c"))
    # A group has as many cells as rounded values of a statistic, some thousands.
    place = Window.partitionBy(*keys, "k")
    upto = F.sum("c").over(place.orderBy("v")).alias("upto")
    ranked = cells.select(*keys, "k", "v", upto, F.sum("c").over(place).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("v")))
    quartiles = ranked.groupBy(*keys, "k").agg(at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"), F.max("n").alias("n"))
    entry = F.struct("k", F.col("b").alias("m"), F.pow((F.col("c") - F.col("a")) / 1.349, 2).alias("s"))
    whole = quartiles.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("e"), F.max("n").alias("n"))
    zero = F.lit(0.0)
    spread = F.array(*[F.get("e", j).s if i == j else zero for i in range(_P) for j in range(i + 1)])
    return whole.select(*keys, "n", F.transform("e", lambda e: e.m).alias("mean"), spread.alias("spread"))


def _at(i: int, j: int) -> int:
    return i * (i + 1) // 2 + j


def _roots(spread: str) -> list[Column]:
    """Entries of the Cholesky factor of the spread with the least spreads added, by rows of the lower
    triangle; each refers to earlier ones as columns _l0, _l1, ..."""
    factor: list[Column] = []
    names: list[Column] = []
    for i in range(_P):
        for j in range(i + 1):
            value = F.get(spread, _at(i, j))
            if i == j:
                value = value + (LEAST_SPREAD[i] * _GRID) ** 2
            for k in range(j):
                value = value - names[_at(i, k)] * names[_at(j, k)]
            value = F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / names[_at(j, j)]
            factor.append(value)
            names.append(F.col(f"_l{_at(i, j)}"))
    return factor


def _factored(groups: DataFrame) -> DataFrame:
    """``groups`` with the Cholesky factor as an array; one column per entry on the way."""
    for n, value in enumerate(_roots("spread")):
        groups = groups.withColumn(f"_l{n}", value)
    entries = [f"_l{n}" for n in range(_P * (_P + 1) // 2)]
    return groups.withColumn("factor", F.array(*entries)).drop("spread", *entries)


def _with_distance(vectors: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``vectors`` with the squared Mahalanobis distance ``d2`` under their group's estimate."""
    rows = attach(vectors, _factored(groups), keys, "n")
    for i in range(_P):
        value = F.get("x", i) - F.get("mean", i)
        for j in range(i):
            value = value - F.get("factor", _at(i, j)) * F.col(f"_y{j}")
        rows = rows.withColumn(f"_y{i}", value / F.get("factor", _at(i, i)))
    d2 = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(_P)), F.lit(0.0))
    return rows.withColumn("d2", d2).drop(*[f"_y{i}" for i in range(_P)], "mean", "factor")


def _moments(rows: DataFrame, keys: list[str], widen: float) -> DataFrame:
    """Mean and covariance (times ``widen``) of each group from its bins' sums; rows hold bin ``b``."""
    x = [F.get("x", i) for i in range(_P)]
    sums = {f"_s{i}": F.sum(x[i]) for i in range(_P)}
    sums |= {f"_q{_at(i, j)}": F.sum(x[i] * x[j]) for i in range(_P) for j in range(i + 1)}
    bins = rows.groupBy(*keys, "n", "b").agg(F.count(F.lit(1)).alias("c"), *[v.alias(k) for k, v in sums.items()])
    # Some hundred bins of distance in a group; those up to the one that completes the share.
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    near = bins.withColumn("_before", F.coalesce(F.sum("c").over(before), F.lit(0))).filter(F.col("_before") < F.ceil(F.col("n") * SHARE))
    whole = near.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("c").alias("c"), *[F.sum(k).alias(k) for k in sums])
    mean = [F.col(f"_s{i}") / F.col("c") for i in range(_P)]
    spread = [(F.col(f"_q{_at(i, j)}") / F.col("c") - mean[i] * mean[j]) * widen for i in range(_P) for j in range(i + 1)]
    return whole.select(*keys, "n", F.array(*mean).alias("mean"), F.array(*spread).alias("spread"))


def estimate(vectors: DataFrame, keys: list[str], steps: int = STEPS, least: int = LEAST_ROWS) -> DataFrame:
    """keys, n, mean and spread (lower triangle) per group of ``least`` rows or more; ``vectors`` hold array ``x``."""
    groups = materialize(_start(vectors, keys).filter(F.col("n") >= least), "groups")
    limit = chi_square_quantile(SHARE, _P)
    # A normal distribution cut at its share is narrower than the whole one.
    widen = SHARE / chi_square(limit, _P + 2)
    for _ in range(steps):
        rows = _with_distance(vectors, groups, keys).filter("d2 is not null")
        binned = rows.withColumn("b", F.floor(F.log2(F.col("d2") + 0.01) * 16))
        groups = materialize(_moments(binned, keys, widen), "groups")
    return groups


def estimates(judged: DataFrame) -> DataFrame:
    """lang, source, n (rows), mean and spread of every group of ``judged``: the estimate of the group drawn to that of
    its language, which is drawn to that of all documents, each with the weight of ``PRIOR_ROWS`` documents."""
    keys = ["lang", "source"]
    sizes = materialize(judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
    vectors = materialize(judged.filter(~F.col("base_failed")).select(*keys, "x"), "vectors")
    whole = estimate(vectors.select(F.lit(0).alias("all"), "x"), ["all"], least=1).first()
    if whole is None:
        empty = F.lit(None).cast("array<double>")
        return sizes.withColumns({"mean": empty, "spread": empty})
    number = lambda xs: F.array(*map(F.lit, xs))
    langs = null_safe_join(sizes.select("lang").distinct(), _passing(estimate(vectors.select("lang", "x"), ["lang"], least=1)), ["lang"])
    langs = _drawn(langs.withColumns({"_mean": number(whole["mean"]), "_spread": number(whole.spread)}))
    langs = materialize(langs.withColumnsRenamed({"mean": "_mean", "spread": "_spread"}), "langs")
    groups = null_safe_join(sizes, _passing(estimate(vectors, keys, least=1)), keys)
    return _drawn(null_safe_join(groups, langs, ["lang"]))


def _passing(groups: DataFrame) -> DataFrame:
    return groups.withColumnRenamed("n", "_passed")


def _drawn(groups: DataFrame) -> DataFrame:
    """mean and spread of ``_passed`` documents, if there are any, drawn to ``_mean`` and ``_spread``."""
    part = F.coalesce(F.col("_passed") / (F.col("_passed") + F.lit(PRIOR_ROWS)), F.lit(0.0))
    mix = lambda own, wide: own * part + wide * (1 - part)
    drawn = {c: F.zip_with(F.coalesce(c, f"_{c}"), f"_{c}", mix) for c in ("mean", "spread")}
    return groups.withColumns(drawn).drop("_mean", "_spread", "_passed")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, distance and kept of every document."""
    rows = materialize(counted(pick(docs, "doc_id", "text", "lang", "source")).withColumn("base_failed", failed()), "counts")
    judged = rows.withColumn("x", F.array(*_vector()))
    done = _with_distance(judged, estimates(judged), ["lang", "source"])
    cutoff = chi_square_quantile(CUTOFF, _P)
    # Without an estimate no document passed the base rule.
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(False))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), F.sqrt("d2").alias("distance"),
    )
