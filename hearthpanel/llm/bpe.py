"""BPE encoding and decoding with bounded lookahead.

Encoding. Merges run in rank order, and two texts with a common prefix can differ in their tokens
only right of a frontier: it starts at the end of the prefix and moves left by len(a) whenever a rule
(a, b) applies across it. For that b must begin, in its leftmost parts, with the left part of the rule
that moved the frontier before, and have a later rank. The longest such chain, one pass over the merge
list, is the sufficient lookahead: a token that ends at least that far left of the end of what was read
keeps its place whatever follows. ``Encoder`` reads a pre-token symbol by symbol, encodes its buffer
when it is full, emits the stable tokens and goes on with the rest.

Decoding. ``Decoder`` is the reverse machine: it takes ids in pieces and gives text as soon as its
UTF-8 bytes are complete.

Nulls are encoded as empty texts; repeated rows get equal results and an empty table an empty one. Texts are
read whole: the text, its normalised and lower-cased copies, its chunks and its ids are held beside one
buffer. Letters and numbers are those of the regex library's Unicode version (17); characters
assigned that late may be split otherwise by a library with an older one. Pre-tokens repeat, so each worker keeps those it met in a table of bounded size.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, spelled out because the regex libraries differ on \s.
_SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAKS = regex.compile(f"[{_SPACES}]+")
CACHED_WORDS = 1 << 16
DECODED_AT_ONCE = 1 << 16
_NO_RULE = 1 << 62


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others in order from 256 up."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str) -> int:
    """Symbols that must be known right of a token's end before it is final."""
    left: dict[str, str] = {}
    reach: dict[str, int] = {}
    longest = 0
    for a, b in merges:
        left.setdefault(a + b, a)
        part: str | None = b
        before = 0
        while part is not None:
            before = max(before, reach.get(part, 0))
            part = left.get(part)
        moved = before + len(a.removesuffix(suffix) if suffix else a)
        reach[a] = max(reach.get(a, 0), moved)
        longest = max(longest, moved)
    return longest


class Encoder:
    """The transducer for one merge list, from bytes to ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, buffer: int = 0):
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + suffix] for c in letters]
        # Of a pair: rank and result in one number, so that the least number is the first rule.
        self.rules = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, suffix)
        self.lengths = {i: len(t.removesuffix(suffix) if suffix else t) for t, i in vocab.items()}
        self.buffer = max(buffer, 2 * self.lookahead, 64)

    def merged(self, ids: list[int]) -> list[int]:
        """All merges on a bounded list, the earliest rule first and from left to right."""
        rule = self.rules.get
        found = list(map(rule, zip(ids, ids[1:]), repeat(_NO_RULE)))
        while found:
            first = min(found)
            if first == _NO_RULE:
                break
            i = found.index(first)
            ids[i] = new = first & 0xFFFFFFFF
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = rule((ids[i - 1], new), _NO_RULE)
            if i < len(found):
                found[i] = rule((new, ids[i + 1]), _NO_RULE)
        return ids

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Ids of one pre-token, emitted as they become final."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) == self.buffer:
                stable, done = len(held) - self.lookahead, 0
                for t in self.merged(held[:]):
                    if done + self.lengths[t] > stable:
                        break
                    done += self.lengths[t]
                    yield t
                del held[:done]
        yield from self.merged(held)

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        if len(data) < self.buffer:
            return self.merged([*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]) if data else []
        return list(self.stream(chain(map(self.inner.__getitem__, data[:-1]), (self.final[data[-1]],))))


class Decoder:
    """Ids to text: gives what is certain, keeps the bytes of an unfinished character.

    ``pieces`` are the bytes of each id, ``between`` the bytes between two ids."""

    def __init__(self, pieces: dict[int, bytes], between: bytes = b""):
        self.pieces, self.between = pieces, between
        self.start()

    def start(self) -> None:
        self.text, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Iterable[int]) -> str:
        data = self.between.join(filter(None, map(self.pieces.get, ids)))
        if data and self.begun:
            data = self.between + data
        self.begun = self.begun or bool(data)
        return self.text.decode(data)

    def finish(self) -> str:
        rest = self.text.decode(b"", True)
        self.start()
        return rest


class Tokenizer:
    """Encoder and decoder of a tokenizer file with word ends, lower case and byte letters."""

    def __init__(self, path: str, buffer: int = 0):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, letters = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or not split["invert"] or letters["type"] != "ByteLevel" or spec["decoder"]:
            raise ValueError(f"{path}: only NFC, white space, lower case, split and byte letters are built")
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.encoder = Encoder(vocab, merges, self.suffix, buffer)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", _SPACES))
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        # Without a decoder in the file the tokens themselves are the text, with a space between.
        self.decoder = Decoder({i: t.encode() for t, i in {**vocab, **self.added}.items()}, b" ")
        self.words: dict[str, bytes] = {}

    def _learn(self, chunk: str) -> bytes:
        parts = self.pattern.findall(chunk)
        if len(parts) > 1:
            data = b"".join([self.words.get(p) or self._learn(p) for p in parts])
        else:
            ids = self.encoder.word(parts[0].encode()) if parts else ()
            data = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[chunk] = data
        return data

    def _plain(self, text: str) -> bytes:
        # Lower case letter by letter: no rule for a sigma that ends a word.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # Pre-tokens hold no white space. str.split also breaks at four controls that are none.
        chunks = _BREAKS.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        known = self.words.get
        return b"".join([data if (data := known(c)) is not None else self._learn(c) for c in chunks])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.added or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(struct.pack("<I", self.added[p]) if p in self.added else self._plain(p) for p in parts)

    def decode(self, ids: bytes) -> str:
        step = 4 * DECODED_AT_ONCE
        parts = [self.decoder.feed(memoryview(ids[i : i + step]).cast("I")) for i in range(0, len(ids), step)]
        return "".join(parts) + self.decoder.finish()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def transcoded(text: Column, path: str) -> Column:
    """Struct of ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``, the text of these ids."""

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def run(texts: pa.Array) -> pa.Array:
        tok = tokenizer(path)
        ids = [tok.encode(t) for t in texts.to_pylist()]
        decoded = [tok.decode(i) for i in ids]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return run(text)


def encoded(text: Column, path: str) -> Column:
    """Ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([tokenizer(path).encode(t) for t in texts.to_pylist()], pa.binary())

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of ids made by ``encoded``; null ids give null."""

    @F.arrow_udf("string")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if i is None else tokenizer(path).decode(i) for i in data.to_pylist()], pa.string())

    return run(ids)
