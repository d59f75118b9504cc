"""Language identification by cross-parsing entropy.

Every language has a reference text. A text is parsed into phrases, each the longest piece found
anywhere in the reference; related text needs few phrases. The language with the fewest phrases, times
the logarithm of its reference's length, per letter of the text wins; ties go to the first by name.

The pieces of a reference are the paths of its suffix automaton. A phrase ends where a transition is
missing and the next begins with that letter (case, kinds of space and digits do not count), so the automaton
with these restarts filled in is a table for its language's frequent letters and a list for the others, and a
batch of texts walks the automata of all languages at once, one letter of every text per step. Texts are cut into blocks of ``BLOCK`` letters at which a phrase ends too; all blocks of a text count.

References are bounded: ``DOCS_PER_LANGUAGE`` different labelled texts by seeded hash, ``DOC_CHARS`` letters
of each from ``PIECES`` seeded places, one in each part of the text. The labels are assumed to be few (names of languages). Null texts, texts without a letter, and
all texts if nothing was learned, are ``und`` with score 0. Equal rows get equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.llm.common import numbered, pick, remainder, renamed

UNKNOWN = "und"
BLOCK = 4096
DOCS_PER_LANGUAGE = 48
DOC_CHARS = 400
PIECES = 5
DENSE = 32
_SPAN = 1 << 62
_DIGIT, _SPACE = re.compile("[0-9]"), re.compile("[ \\t\\n\\r\\v\\f\\xa0]")


def _sample(place: Column) -> Column:
    """Letters of ``dense`` from a seeded place in each of ``PIECES`` equal parts; a short text whole."""
    size = DOC_CHARS // PIECES
    part = F.floor(F.length("dense") / PIECES)
    within = lambda k: F.pmod(F.xxhash64(place, F.lit(k)), F.greatest(part - size + 1, F.lit(1)))
    pieces = [F.substr("dense", (part * k + within(k) + 1).cast("int"), F.lit(size)) for k in range(PIECES)]
    return F.when(F.length("dense") <= DOC_CHARS, F.col("dense")).otherwise(F.concat_ws("\n", *pieces))


def references(docs: DataFrame, learn: Column) -> dict[str, str]:
    """Reference text per language from rows for which ``learn`` holds (over doc_id, text, lang)."""
    known = pick(docs, "doc_id", "text", "lang").filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.xxhash64("text")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(place).alias("texts")).collect()
    if not counts:
        return {}
    # Some four times as many as needed pass by hash; equal texts count once.
    part = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 4 * DOCS_PER_LANGUAGE / r.texts))])
    passed = known.filter(place.bitwiseAND(F.lit(_SPAN - 1)) < part[F.col("lang")] * F.lit(float(_SPAN)))
    # Long runs without a letter, as in tables, would take the places of letters.
    dense = passed.select("lang", place.alias("place"), F.regexp_replace("text", r"\P{L}{9,}", " ").alias("dense"))
    some = dense.groupBy("lang", "place").agg(F.min(_sample(F.col("place"))).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    rows = some.withColumn("n", first).filter(F.col("n") <= DOCS_PER_LANGUAGE).collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        texts.setdefault(r.lang, []).append((r.n, r.text))
    return {lang: "\n".join(t for _, t in sorted(texts[lang])) for lang in sorted(texts)}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the empty one."""
    moves: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if depth[p] + 1 == depth[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                depth.append(depth[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Parser:
    """Tables of all languages, for batches of texts.

    Every language has an alphabet of its own, all letters of its reference. Its ``DENSE`` most frequent
    letters are columns of a table; the transitions of the others, of which most states have none, are one
    sorted list. So a reference of thousands of letters takes the memory of its transitions.
    """

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in texts]
        counts = [Counter(_DIGIT.sub("0", _SPACE.sub(" ", text.lower()))) for _, text in texts]
        letters = sorted(set().union(*counts)) if counts else []
        self.code = np.zeros(0x110000, np.int32)  # 0: a letter of no reference
        for i, c in enumerate(letters, 1):
            same = {c, c.upper()} | ({*"0123456789"} if c == "0" else {*" \t\n\r\v\f\xa0"} if c == " " else set())
            self.code[[ord(x) for x in same if len(x) == 1]] = i
        number = {c: i for i, c in enumerate(letters, 1)}
        # Column 0: not in this reference; 1: looked up in the list.
        self.column = np.zeros((len(letters) + 1, len(texts)), np.int32)
        tables, keys, values, size = [], [], [], 0
        self.starts = []
        for n, (_, text) in enumerate(texts):
            own = sorted(counts[n], key=lambda c: (-counts[n][c], c))
            dense = {number[c]: i for i, c in enumerate(own[:DENSE], 2)}
            self.column[[number[c] for c in own], n] = 1
            self.column[list(dense), n] = list(dense.values())
            moves = suffix_automaton(self._codes(text).tolist())
            width = len(dense) + 2
            if size + (len(moves) + 1) * width >= _CUT:
                raise ValueError("the references are too large for one table")
            # A letter the reference lacks is a phrase of its own: a state that every letter leaves.
            nowhere = size + len(moves) * width
            begin = np.full(width, nowhere, np.int32)
            for c, to in moves[0].items():
                if c in dense:
                    begin[dense[c]] = size + to * width
            table = np.tile(begin | np.int32(_CUT), (len(moves) + 1, 1))
            table[0] = begin
            table[:, 1] = _LISTED
            for state, out in enumerate(moves):
                for c, to in out.items():
                    if c in dense:
                        table[state, dense[c]] = size + to * width
                    elif c:
                        keys.append((size + state * width) << _LETTER_BITS | c)
                        values.append(size + to * width)
            tables.append(table.ravel())
            self.starts.append(size)
            size += table.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        # A last key that none is beyond.
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int32)[order], np.int32(0))
        self.first = np.array(self.starts, np.int64)
        self.weight = np.array([np.log2(len(text) + 2) for _, text in texts])

    def _listed(self, state: np.ndarray, letter: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Transitions by rare letters; where there is none a phrase ends and the next begins with the letter."""
        key = state.astype(np.int64) << _LETTER_BITS | letter
        at = np.searchsorted(self.keys, key)
        out = self.values[at]
        ends = np.flatnonzero(self.keys[at] != key)
        if len(ends):
            again = self.first[language[ends]] << _LETTER_BITS | letter[ends]
            out[ends] = self.values[np.searchsorted(self.keys, again)] | _CUT
        return out

    def _codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Numbers of phrases, one row per text, one column per language."""
        codes = [self._codes(t) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        first = np.concatenate([np.arange(n) for n in blocks] or [np.zeros(0, np.int64)]) * BLOCK
        length = np.minimum(sizes[owner] - first, BLOCK)
        begin = (np.cumsum(sizes) - sizes)[owner] + first
        order = np.argsort(-length, kind="stable")
        length, begin = length[order], begin[order]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        state = np.tile(np.array(self.starts, np.int32), (len(order), 1))
        cuts = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        for t, n in enumerate(live):
            letter = flat[begin[:n] + t]
            to = self.table[state[:n] + self.column[letter]]
            if self.values.size > 1:
                row, language = np.nonzero(to == _LISTED)
                if len(row):
                    to[row, language] = self._listed(state[row, language], letter[row], language)
            cuts[:n] += to >> _CUT_BIT
            np.bitwise_and(to, _CUT - 1, out=state[:n])
        total = np.zeros((len(texts), len(self.names)), np.int64)
        np.add.at(total, owner[order], cuts + 1)
        return total

    def best(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.names and any(map(str.isalpha, t))]
        # Some megabytes of letters at a time.
        group: list[int] = []
        held = 0
        for i in [*at, -1]:
            if group and (i < 0 or held > 4_000_000):
                bits = self.phrases([texts[j] for j in group]) * self.weight / np.array([[len(texts[j])] for j in group])
                for j, row in zip(group, bits):
                    k = int(np.argmin(row))
                    rest = np.delete(row, k)
                    out[j] = self.names[k], float(1 - row[k] / rest.min()) if len(rest) else 1.0
                group, held = [], 0
            if i >= 0:
                group.append(i)
                held += len(texts[i])
        return out


_CUT_BIT = 30
_CUT = 1 << _CUT_BIT
_LISTED = -1
_LETTER_BITS = 21


@lru_cache(maxsize=1)
def parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(texts)


def identified(text: Column, texts: dict[str, str]) -> Column:
    """Struct of ``lang_pred`` and ``score``, the margin to the next language."""
    given = tuple(texts.items())

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batch: pa.Array) -> pa.Array:
        found = parser(given).best(batch.to_pylist())
        names, scores = [f[0] for f in found], [f[1] for f in found]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # Else a filter on the result would be evaluated before it, and the texts parsed twice.
    return run.asNondeterministic()(text)


def learned(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return remainder(doc_id, 4) != 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    texts = references(docs, learned(F.col("doc_id")))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", (~learned(F.col("doc_id"))).alias("held_out"), identified(F.col("text"), texts).alias("found")
    )
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents in a language that was learned, with ``lang`` as identified; the others go."""
    texts = references(docs, learned(F.col("doc_id")))
    plain, names = numbered(docs)
    found = plain.withColumn("found", identified(F.col(f"c{names.index('text')}"), texts))
    return renamed(found.filter(F.col("found.lang_pred") != UNKNOWN), names, lang=F.col("found.lang_pred"))
