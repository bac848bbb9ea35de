"""Token counts by byte-pair merging.

A segment starts as one symbol per character. A heap holds the adjacent pairs whose
concatenation is a piece, the best rank first, then the leftmost; a popped pair is merged in a
linked list and brings its new neighbours to the heap. Characters that are no piece count
their bytes. The count is the initial symbols minus the merges; no identifier is made.

Segments are cut where no piece of the vocabulary can reach across, so merging them one by one
equals merging the whole text, and equal segments are counted once per worker. The vocabulary
file is read on each worker; its pieces and ranks are all that is taken from the library.

Defined cases: null and empty texts have no bytes and no tokens. Repeated rows and null ids
keep their rows. Other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from tarmac.llm.common import map_arrow

SPACE = "▁"
# Bounds of a worker's cache: entries, and the longest segment that is kept.
CACHED, CACHED_CHARS = 1_000_000, 48


def merged_count(segment: str, ranks: dict[str, float]) -> int:
    """Tokens of ``segment``; ``ranks`` has every piece, lower values merge first."""
    symbols = list(segment)
    last = len(symbols)
    left, right = list(range(-1, last - 1)), list(range(1, last + 1))
    count = sum(1 if s in ranks else len(s.encode()) for s in symbols)
    heap = []
    for i in range(last - 1):
        rank = ranks.get(symbols[i] + symbols[i + 1])
        if rank is not None:
            heap.append((rank, i, i + 1, 2))
    heapify(heap)
    while heap:
        _, i, j, width = heappop(heap)
        a, b = symbols[i], symbols[j]
        if not a or not b or len(a) + len(b) != width:
            continue
        symbols[i], symbols[j] = a + b, ""
        count -= 1
        after = right[j]
        right[i] = after
        if after < last:
            left[after] = i
            rank = ranks.get(symbols[i] + symbols[after])
            if rank is not None:
                heappush(heap, (rank, i, after, width + len(symbols[after])))
        before = left[i]
        if before >= 0:
            rank = ranks.get(symbols[before] + symbols[i])
            if rank is not None:
                heappush(heap, (rank, before, i, len(symbols[before]) + width))
    return count


class SegmentCounts(dict):
    """Counts by segment, computed when missing; emptied when full."""

    def __init__(self, ranks: dict[str, float]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, segment: str) -> int:
        count = merged_count(segment, self.ranks)
        if len(segment) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[segment] = count
        return count


def segment_pattern(pieces: list[str]) -> re.Pattern:
    """Splits a text where no piece reaches across.

    A run of spaces can only begin a piece if no piece has one after another character. ASCII
    characters that occur in no longer piece stand alone. Punctuation is cut from its
    neighbours where no piece has both; characters that do share a piece with it join it.
    """
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return re.compile(r"(?s).+")
    longer = [p.lstrip(SPACE) for p in pieces if len(p) > 1]
    inside = {c for p in longer for c in p}
    lone = [c for c in map(chr, range(128)) if c not in inside]
    marks = {c for c in string.punctuation if c in inside}
    while more := {c for p in longer if marks & set(p) for c in p} - marks:
        marks |= more
    if marks & set(string.ascii_letters):
        marks = set()
    rest = f"[^{_escaped([SPACE, *lone, *marks])}]+"
    runs = f"[{_escaped(marks)}]+|{rest}" if marks else rest
    alone = f"[{_escaped(lone)}]|" if lone else ""
    return re.compile(f"{alone}{SPACE}*(?:{runs})|{SPACE}+")


def _escaped(characters: Iterable[str]) -> str:
    return "".join(re.escape(c) for c in sorted(characters))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[re.Pattern, SegmentCounts]:
    """Segment pattern and cache for a sentence-piece BPE model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ranks = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            ranks[model.id_to_piece(i)] = -model.get_score(i)
    return segment_pattern(list(ranks)), SegmentCounts(ranks)


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of a whole text as a model with a dummy prefix and no normalisation has them."""
    if not text:
        return 0
    pattern, counts = vocabulary(path)
    marked = SPACE + text.replace(" ", SPACE)
    return sum(map(counts.__getitem__, pattern.findall(marked)))


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column("text"):
                found = text.as_py()
                sizes.append(len(found.encode()) if found else 0)
                counts.append(count_tokens(found, path))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = (
        docs.select("doc_id")
        .schema.add("n_bytes", "long")
        .add("n_tokens", "long")
        .add("over_limit", "boolean")
    )
    return map_arrow(docs.select("doc_id", "text"), run, schema)
