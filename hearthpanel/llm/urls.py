"""URL filters: rules first, then host word segmentation and naive Bayes.

The longest rule that fits a url decides. Other urls are judged by a multinomial naive Bayes model over
the words of host and path, learned from the urls that rules decide. Names that run words together are
split before: a Viterbi search finds the most likely words under a unigram model of the words in the
pages' texts and in the separated parts of all urls; letters in no known word are split off as runs with
a cost per letter.

Words count from ``LEAST_COUNT`` occurrences on, in a written table of any size; each distinct run of letters
gets those of its pieces that are words by a join. The model is bounded: ``BUCKETS`` hashed words per
class. Counting covers all pages. Urls that are null or have no ``://`` have empty host and path and no words,
so the classes' shares decide; ties allow; without decided urls all others are allowed. Repeated rows
count as often as they occur and get equal results.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import pick
from hearthpanel.operators.keyed import attach, null_safe_join
from hearthpanel.workspace import materialize

ALLOW, BLOCK = "allow", "block"
RULES = (
    (ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"),
)
LEAST_COUNT = 3
LONGEST_WORD = 24
# Letters of a name whose pieces one row holds; any number gives the same words.
SLICE = 1024
BUCKETS = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PART = "[a-z]+|[0-9]+"
_NUMBER = "0"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Splits runs of letters into the most likely words."""

    def __init__(self, counts: Iterable[tuple[str, int]], total: int | None = None):
        """``counts`` of the words that may occur; ``total`` of all words, if there are more."""
        counts = list(counts)
        total = sum(n for _, n in counts) + 1 if total is None else total
        self.cost = {w: math.log(total / n) for w, n in counts}
        # An unknown letter costs more than the rarest word, so known words are used where they fit.
        self.unknown = math.log(total) + 2.0

    def split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, begin = best[end - 1] + self.unknown, end - 1
            for start in range(max(0, end - LONGEST_WORD), end):
                c = self.cost.get(name[start:end])
                if c is not None and best[start] + c < cost:
                    cost, begin = best[start] + c, start
            best.append(cost)
            back.append(begin)
        words, end = [], len(name)
        while end:
            words.append((name[back[end] : end], name[back[end] : end] in self.cost))
            end = back[end]
        out: list[str] = []
        loose = False
        for word, is_known in reversed(words):
            if not is_known and loose:
                out[-1] += word  # neighbouring unknown letters are one run
            else:
                out.append(word)
            loose = not is_known
        return tuple(out)


def word_counts(urls: DataFrame, html: Column) -> DataFrame:
    """word and n of the words of the texts between tags and of the parts of all urls."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    both = F.lower(F.concat_ws(" ", plain, F.col("host"), F.col("path")))
    each = urls.select(F.explode(F.regexp_extract_all(both, F.lit("[a-z]+"), 0)).alias("word"))
    counts = each.filter(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.filter(F.col("n") >= LEAST_COUNT), "words")


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``names`` (distinct runs of letters in ``name``) with their most likely words as ``words``."""
    total = (counts.agg(F.sum("n")).first()[0] or 0) + 1
    # Long names are not repeated for each of their pieces.
    key = F.when(F.length("name") > 32, F.concat(F.lit("#"), F.md5("name"))).otherwise(F.col("name"))
    names = names.withColumn("key", key)
    # Long names are cut into slices, each with the beginning of the next, so no row holds more than a slice's pieces.
    cut = lambda i: F.substr("name", i * SLICE + 1, F.lit(SLICE + LONGEST_WORD - 1))
    last = F.floor((F.length("name") - 1) / SLICE).cast("int")
    slices = names.select("key", F.explode(F.transform(F.sequence(F.lit(0), last), cut)).alias("slice"))
    ends = lambda i: F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("slice") - i + 1))
    at = lambda i: F.transform(ends(i), lambda k: F.substr("slice", i, k))
    starts = F.sequence(F.lit(1), F.least(F.lit(SLICE), F.length("slice")))
    pieces = slices.select("key", F.explode(F.array_distinct(F.flatten(F.transform(starts, at)))).alias("word"))
    known = null_safe_join(pieces.groupBy("word").agg(F.count(F.lit(1)).alias("rows")), counts, ["word"], "inner")
    found = attach(pieces, known, ["word"], "rows").filter("n is not null")
    # Slices of one name share words.
    found = found.groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("found"))
    found = found.select("key", F.col("found.word").alias("found"), F.col("found.n").alias("ns"))

    @F.arrow_udf("array<string>")
    def run(names: pa.Array, found: pa.Array, ns: pa.Array) -> pa.Array:
        rows = zip(names.to_pylist(), found.to_pylist(), ns.to_pylist())
        return pa.array([Segmenter(zip(f or [], n or []), total).split(t) for t, f, n in rows], pa.list_(pa.string()))

    done = null_safe_join(names, found, ["key"]).withColumn("words", run("name", "found", "ns"))
    return done.drop("key", "found", "ns")


def segmented(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``urls`` with the words of host and path in order; those of the path are marked, numbers are all one."""
    pairs = materialize(urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows")), "pairs")
    of = lambda text, mark: F.transform(
        F.regexp_extract_all(text, F.lit(_PART), 0), lambda x: F.struct(F.lit(mark).alias("mark"), x.alias("name"))
    )
    parts = F.concat(of(F.col("host"), ""), of(F.lower("path"), "/"))
    each = pairs.select("host", "path", F.posexplode(parts).alias("place", "part")).select("host", "path", "place", "part.*")
    names = each.filter("name >= 'a'").groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    split = split_names(materialize(names, "names"), counts)
    one = attach(each, split, ["name"], "rows").drop("rows")
    marked = F.transform(F.coalesce("words", F.array(F.lit(_NUMBER))), lambda w: F.concat("mark", w))
    whole = one.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("place", marked.alias("w")))).alias("parts"))
    words = F.coalesce(F.flatten(F.transform("parts", lambda p: p.w)), F.array().cast("array<string>"))
    done = null_safe_join(pairs, whole, ["host", "path"]).select("host", "path", "rows", words.alias("words"))
    return attach(urls, done, ["host", "path"], "rows").drop("rows")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


class Bayes:
    """Multinomial naive Bayes with add-one smoothing over hashed words."""

    def __init__(self, shares: dict[str, int], counts: tuple[tuple[str, int, int], ...]):
        n = {k: shares.get(k, 0) for k in (ALLOW, BLOCK)}
        self.prior = math.log((n[BLOCK] + 1) / (n[ALLOW] + 1)) if n[BLOCK] else -math.inf
        kinds = len(counts) + 1
        allowed, blocked = sum(c[1] for c in counts) + kinds, sum(c[2] for c in counts) + kinds
        self.unseen = math.log(allowed / blocked)
        self.weight = {int(b): math.log((y + 1) / blocked) - math.log((x + 1) / allowed) for b, x, y in counts}

    def score(self, buckets: list[int]) -> float:
        """Logarithm of the odds for block."""
        return self.prior + sum(self.weight.get(b, self.unseen) for b in buckets)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words and score of every page."""
    rows = pick(pages, "page_id", "url", "html")
    urls = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    counts = word_counts(urls, F.col("html"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("decided"))
    urls = materialize(segmented(materialize(urls, "urls"), counts), "urls")
    hashed = F.transform("words", lambda w: F.pmod(F.crc32(w), F.lit(BUCKETS)))
    known = urls.filter("decided is not null")
    shares = {r.decided: r.n for r in known.groupBy("decided").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = known.select("decided", F.explode(hashed).alias("b")).groupBy("b")
    by_kind = [F.count(F.when(F.col("decided") == k, 1)).alias(k) for k in (ALLOW, BLOCK)]
    weights = tuple(tuple(r) for r in each.agg(*by_kind).collect())

    @F.arrow_udf("double")
    def odds(buckets: pa.Array) -> pa.Array:
        score = bayes(tuple(shares.items()), weights).score
        return pa.array([score(b or []) for b in buckets.to_pylist()], pa.float64())

    done = urls.withColumn("score", odds(hashed))
    judged = F.coalesce("decided", F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW))
    return done.select("page_id", "host", "path", "rule", judged.alias("verdict"), "words", "score")


@lru_cache(maxsize=2)
def bayes(shares: tuple[tuple[str, int], ...], counts: tuple[tuple[str, int, int], ...]) -> Bayes:
    return Bayes(dict(shares), counts)
