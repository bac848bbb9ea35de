"""Byte-level byte-pair encoding and decoding.

A text is cut into pre-tokens by the vocabulary's pattern. A pre-token that is a token stands
for itself; any other starts as single bytes, and adjacent parts merge in the order of the
rank of what they form, the leftmost first among equals. The next rank comes from a
hierarchical bitmap: one bucket per rank holds the places in a linked list of parts where that
merge is due, a bit per bucket says whether it has any, and a bit per word of those bits whether
any of them is set; find-first-set in both gives the lowest rank. An entry whose place has since
merged otherwise is stale and skipped. Every merge costs a few steps however long the pre-token
is, and in a very long one a place costs some twenty bytes.

Pre-tokens repeat, so a worker keeps the identifiers of those it has seen, up to ``HELD``
characters. Texts are encoded in slices of ``SLICE`` pre-tokens, and output leaves in batches of
about ``BATCH`` bytes. Only the vocabulary travels to the workers, with the job.

Defined cases: a null text has no tokens and is decoded to no bytes, like an empty one. Texts
of any length are encoded whole; a very long one is the only row of its output batch. Repeated
rows, equal and null ids keep their rows. Extra columns are kept, whatever their names; one
that is called like an output column (in any case) is replaced. An empty table gives an empty
table. Null identifiers decode like an empty list, unknown ones are an error.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice, product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tarmac.llm.common import map_arrow

# Pre-tokens of one slice, characters of pre-tokens a worker keeps, bytes of an output batch.
SLICE, HELD, BATCH = 1 << 16, 1 << 23, 1 << 24
# Bits of a bitmap word, as a power of two; pre-tokens from so many bytes are held in arrays.
WORD_BITS, LONG = 9, 1 << 12

BEYOND = re.compile("[\U00010000-\U0010ffff]")

# Letters and numbers that Unicode has assigned since its version 16, the one
# that the encoder's library knows. It takes them for signs.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
# End of fixed values.


def _later(ranges: str) -> set[int]:
    ends = [r.split("-") for r in ranges.split()]
    return {c for e in ends for c in range(int(e[0], 16), int(e[-1], 16) + 1)}


@lru_cache(maxsize=2)
def _classes(last: int) -> dict[str, str]:
    """The insides of character classes for letters, numbers and white space up to ``last``."""
    import regex

    surrogates = range(0xD800, 0xE000)
    every = "".join(chr(c) for c in range(last + 1) if c not in surrogates)
    found = {}
    for name, later in ((r"\p{L}", LATER_LETTERS), (r"\p{N}", LATER_NUMBERS), (r"\s", "")):
        points = np.array(sorted({ord(c) for c in regex.findall(name, every)} - _later(later)))
        starts = points[np.diff(points, prepend=-2) != 1]
        ends = points[np.diff(points, append=sys.maxunicode + 2) != 1]
        found[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))
    return found


def spelled_out(pattern: str, last: int) -> str:
    """``pattern`` with its classes as lists of characters up to ``last``, in an older Unicode."""
    classes = _classes(last)
    names = re.compile(r"\\p\{[LN]\}|\\s")
    sets = re.compile(r"\[\^?(?:\\p\{[LN]\}|\\s)+\]|\\p\{[LN]\}|\\s|\\S")

    def spelled(found: re.Match) -> str:
        if found.group() == r"\S":
            return f"[^{classes[chr(92) + 's']}]"
        text = names.sub(lambda m: classes[m.group()], found.group())
        return text if text.startswith("[") else f"[{text}]"

    return sets.sub(spelled, pattern)


class Places:
    """A bucket of a very long pre-token: places in rising order, and late ones in a heap.

    Any other bucket is a heap.
    """

    def __init__(self, place: int):
        self.run, self.used, self.late = array("i", (place,)), 0, []

    def add(self, place: int) -> None:
        if place > self.run[-1]:
            self.run.append(place)
        else:
            heappush(self.late, place)

    def take(self) -> int:
        if self.late and (self.used == len(self.run) or self.late[0] < self.run[self.used]):
            return heappop(self.late)
        self.used += 1
        return self.run[self.used - 1]

    def __len__(self) -> int:
        return len(self.run) - self.used + len(self.late)


class Vocabulary:
    """Ranks of a file with one base64 token and its rank a line, and the pre-token pattern."""

    def __init__(self, data: bytes, pattern: str):
        lines = (line.split() for line in data.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        tokens = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.stock = pa.array(tokens, pa.binary())
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.bytes = [self.ranks.get(bytes([b])) for b in range(256)]
        # Rank of what two bytes form, -1 for none.
        self.pairs = [self.ranks.get(bytes(p), -1) for p in product(range(256), repeat=2)]
        self.words = [0] * (1 + (len(tokens) >> WORD_BITS))
        # Classes without characters beyond the first plane are tested faster.
        self.narrow = re.compile(spelled_out(pattern, 0xFFFF))
        self.wide = re.compile(spelled_out(pattern, sys.maxunicode))
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.ends, self.held = array("i"), array("q", (0,)), 0

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of ``text``, a slice at a time."""
        pattern = self.wide if BEYOND.search(text) else self.narrow
        if 0 < len(text) <= SLICE:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while some := [m.group() for m in islice(found, SLICE)]:
            yield some

    def code(self, piece: str) -> int:
        """Where the identifiers of ``piece`` are kept; computed when new."""
        known = self.codes.get(piece)
        if known is None:
            self.flat.extend(self.merged(piece.encode()))
            self.ends.append(len(self.flat))
            self.held += len(piece) + 1
            known = self.codes[piece] = len(self.ends) - 2
        return known

    def merged(self, piece: bytes) -> Iterable[int]:
        """Identifiers of one pre-token."""
        rank_of, tokens, words = self.ranks.get, self.tokens, self.words
        if (whole := rank_of(piece)) is not None:
            return (whole,)
        last, mask = len(piece), (1 << WORD_BITS) - 1
        parts = [self.bytes[b] for b in piece]
        right, left = range(1, last + 1), range(-1, last - 1)
        # The rank of the merge that is due at a place; -1 for none.
        pairs = self.pairs
        due = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        due.append(-1)
        if short := last < LONG:
            add, take = heappush, heappop
            right, left = list(right), list(left)
        else:
            add, take = Places.add, Places.take
            right, left = array("i", right), array("i", left)
            parts, due = array("i", parts), array("i", due)
        buckets: dict[int, list | Places] = {}
        filled = 0
        for i, rank in enumerate(due):
            if rank in buckets:
                add(buckets[rank], i)
            elif rank >= 0:
                buckets[rank] = [i] if short else Places(i)
                words[rank >> WORD_BITS] |= 1 << (rank & mask)
                filled |= 1 << (rank >> WORD_BITS)
        while filled:
            at = (filled & -filled).bit_length() - 1
            word = words[at]
            rank = at << WORD_BITS | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = take(bucket)
            if not bucket:
                del buckets[rank]
                words[at] = word = word & (word - 1)
                if not word:
                    filled &= filled - 1
            if due[i] != rank:
                continue
            j = right[i]
            after, before = right[j], left[i]
            parts[i], parts[j], due[j] = rank, -1, -1
            right[i] = after
            token = tokens[rank]
            if after < last:
                left[after] = i
                due[i] = new = rank_of(token + tokens[parts[after]], -1)
                if new in buckets:
                    add(buckets[new], i)
                elif new >= 0:
                    buckets[new] = [i] if short else Places(i)
                    words[new >> WORD_BITS] |= 1 << (new & mask)
                    filled |= 1 << (new >> WORD_BITS)
            else:
                due[i] = -1
            if before >= 0:
                due[before] = new = rank_of(tokens[parts[before]] + token, -1)
                if new in buckets:
                    add(buckets[new], before)
                elif new >= 0:
                    buckets[new] = [before] if short else Places(before)
                    words[new >> WORD_BITS] |= 1 << (new & mask)
                    filled |= 1 << (new >> WORD_BITS)
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> np.ndarray:
        """Identifiers of a whole text."""
        found = []
        for pieces in self.pieces(text or ""):
            if self.held > HELD:
                self.forget()
            get, code = self.codes.get, self.code
            codes = np.array([c if (c := get(p)) is not None else code(p) for p in pieces])
            ends = np.frombuffer(self.ends, np.int64)
            starts = ends[codes]
            counts = ends[codes + 1] - starts
            upto = np.cumsum(counts)
            at = np.repeat(starts - (upto - counts), counts) + np.arange(upto[-1])
            found.append(np.frombuffer(self.flat, np.int32)[at])
            del ends
        return np.concatenate(found) if found else np.empty(0, np.int32)

    def decode(self, ids: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
        """The bytes of the identifiers, one after another, and the length of each."""
        numbers = ids.to_numpy(zero_copy_only=False)
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= len(self.tokens)):
            raise ValueError("an identifier is not in the vocabulary")
        data = self.stock.take(pa.array(numbers)).buffers()[2]
        return data or pa.py_buffer(b""), self.lengths[numbers]


@lru_cache(maxsize=2)
def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    """One vocabulary for all tasks of a worker."""
    return Vocabulary(data, pattern)


def _with_columns(df: DataFrame, added: dict) -> tuple[StructType, list[int]]:
    """Schema of ``df`` with the added columns last, and the places of the columns that stay."""
    lowered = {name.lower() for name in added}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in lowered]
    fields = [df.schema.fields[i] for i in kept]
    return StructType(fields + [StructField(n, k) for n, k in added.items()]), kept


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``BATCH`` units each."""
    upto = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = upto[start - 1] if start else 0
        end = max(start + 1, bisect_left(upto, before + BATCH))
        yield start, end
        start = end


def _text_sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)


def _encode(known: Vocabulary, texts: pa.Array) -> pa.Array:
    found = [known.encode(t.as_py()) for t in texts]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))


def _decode(known: Vocabulary, lists: pa.Array) -> pa.Array:
    counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    joined, sizes = known.decode(lists.flatten())
    upto = np.concatenate([[0], np.cumsum(sizes)])
    ends = upto[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), joined])


def _coded(
    df: DataFrame, path: str, pattern: str, source: str, sizes: Callable, added: dict, make: Callable
) -> DataFrame:
    """``df`` with the columns that ``make`` gets from ``source``, batch by batch."""
    data, at = Path(path).read_bytes(), df.columns.index(source)
    schema, kept = _with_columns(df, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(data, pattern)
        for batch in batches:
            names = [batch.schema.names[i] for i in kept] + list(added)
            for start, end in _cuts(sizes(batch.column(at))):
                part = batch.slice(start, end - start)
                columns = [part.column(i) for i in kept] + make(known, part.column(at))
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(df, run, schema)


IDS, BYTES = ArrayType(IntegerType()), BinaryType()


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the token identifiers of every whole text in ``ids``.

    ``path`` is read where this is called, so it may be a file of the driver alone.
    """

    def make(known: Vocabulary, texts: pa.Array) -> list[pa.Array]:
        return [_encode(known, texts)]

    return _coded(docs, path, pattern, text, _text_sizes, {"ids": IDS}, make)


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with the bytes that the identifiers stand for in ``decoded``."""

    def sizes(lists: pa.Array) -> np.ndarray:
        return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False) * 4

    def make(known: Vocabulary, lists: pa.Array) -> list[pa.Array]:
        return [_decode(known, lists)]

    return _coded(df, path, pattern, ids, sizes, {"decoded": BYTES}, make)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and what these ``decoded`` to, in one pass."""

    def make(known: Vocabulary, texts: pa.Array) -> list[pa.Array]:
        ids = _encode(known, texts)
        return [ids, _decode(known, ids)]

    return _coded(docs, path, pattern, text, _text_sizes, {"ids": IDS, "decoded": BYTES}, make)


def byte_bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text.

    The digests are taken of the identifiers and bytes that ``round_trip`` returns.
    """
    coded = round_trip(docs.select("doc_id", "text"), path, pattern)
    numbers = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
