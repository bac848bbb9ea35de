"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its character 4-grams; the filters are bit-sliced: row i
of the table holds bit i of every language's filter as one mask, so one lookup per hash
function returns all languages that contain a gram. A document sums the masks' bits per
language, corrects the sums for each filter's false positives and takes the largest.

A gram belongs to a language if it makes up at least ``MIN_RATE`` of the language's grams, which
bounds a filter's load at any corpus size, and if the language has at least ``MIN_SHARE`` of its
summed rates, so that texts with a wrong label do not spread grams to every language. Rates are
taken over all training texts.

Defined cases: a null text and a text without a letter are ``und`` with score 0, as is
everything without training texts. A letter is what Unicode calls one, in any plane. A text
with letters but no known gram gets the language with most of the training grams, and its part
of them as score. Ties go to the first language by code point. Repeated rows and null ids keep
their rows. An empty table gives an empty table. Only the text is read for a prediction.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import map_arrow, map_pandas, remainder, stored

ROWS, HASHES = 1 << 21, 3
MIN_RATE, MIN_SHARE = 1 / 200_000, 0.05
# Languages per mask; more languages take more masks.
MASK = 63
# Characters that a task works on at once, and distinct grams it holds.
CHUNK, GATHERED = 1 << 20, 1 << 20
UNKNOWN = "und"
# Code points of a gram are the digits of a number in this base, modulo 2^64.
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Is the code point a letter?"""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character 4-grams of lower-cased letters and single gaps as 64-bit numbers, their text,
    and which texts have a letter. Every text begins and ends with a gap."""
    lines = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    letter = _letters()[codes]
    before = np.concatenate([[False], letter[:-1]])
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else letter
    keep = letter | before | first
    line = np.where(letter, codes, 32)[keep].astype(np.uint64)
    of = owner[keep]
    has = np.bincount(owner, letter, len(lines)) > 0
    if len(line) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    found = np.zeros(len(line) - 3, np.uint64)
    for k in range(4):
        found = found * GRAM_BASE + line[k : len(line) - 3 + k]
    whole = of[:-3] == of[3:]
    return found[whole], of[:-3][whole], has


def slots(found: np.ndarray) -> list[np.ndarray]:
    """Rows of the table for each hash function."""
    result = []
    for m in MULTIPLIERS[:HASHES]:
        mixed = (found ^ found >> np.uint64(29)) * np.uint64(m)
        result.append((mixed >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64))
    return result


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Start and texts of slices with about ``CHUNK`` characters; a null text is empty."""
    start, held, size = 0, [], 0
    for i, value in enumerate(batch.column("text")):
        text = value.as_py() or ""
        if held and size + len(text) > CHUNK:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def gram_counts(training: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all of ``training`` (``lang, text``); stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for start, texts in _chunks(batch):
                found, of, _ = grams(texts)
                here = langs[start : start + len(texts)]
                for lang in set(here):
                    own = np.unique(found[(here == lang)[of]], return_counts=True)
                    kept[lang] = _summed(kept.get(lang), *own)
                size = sum(len(k[0]) for k in kept.values())
                if size > GATHERED:
                    yield from send(kept)
                    kept = {}
        yield from send(kept)

    def send(kept):
        for lang, (keys, counts) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)],
                names=["lang", "gram", "n"],
            )

    rows = map_arrow(training.select("lang", "text"), run, "lang string, gram long, n long")
    return stored(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def _summed(kept, keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    if kept is None:
        return [keys, counts.astype(np.int64)]
    every, place = np.unique(np.concatenate([kept[0], keys]), return_inverse=True)
    sums = np.bincount(place, np.concatenate([kept[1], counts]), len(every))
    return [every, sums.astype(np.int64)]


@dataclass
class Filters:
    """``masks[w][row]`` has a bit per language of word w; ``false`` the rates of chance hits;
    ``shares`` the parts of the training grams."""

    langs: list[str]
    masks: list[np.ndarray]
    false: np.ndarray
    shares: np.ndarray


def learn(training: DataFrame) -> Filters | None:
    """Filters from texts with a language; none without any.

    The driver gets one row per used row of the table, of which there are ``ROWS`` at most.
    """
    counts = gram_counts(training)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    of_lang = {r["lang"]: r["total"] for r in totals.collect()}
    langs = sorted(of_lang, key=lambda x: x.encode("utf-8", "surrogatepass"))
    if not langs:
        return None
    rates = counts.join(F.broadcast(totals), "lang").select(
        "lang", "gram", (F.col("n") / F.col("total")).alias("rate")
    )
    summed = rates.groupBy("gram").agg(F.sum("rate").alias("every"))
    owned = rates.join(summed, "gram").where(
        (F.col("rate") >= MIN_RATE) & (F.col("rate") >= MIN_SHARE * F.col("every"))
    )
    places = {lang: i for i, lang in enumerate(langs)}

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place = frame["lang"].map(places).to_numpy(np.int64)
            for at in slots(frame["gram"].to_numpy(np.int64).view(np.uint64)):
                yield pd.DataFrame({"slot": at, "word": place // MASK, "bit": 1 << place % MASK})

    bits = (
        map_pandas(owned.select("lang", "gram"), hashed, "slot long, word long, bit long")
        .groupBy("slot", "word")
        .agg(F.bit_or("bit").alias("mask"))
        .toArrow()
        .to_pandas()
    )
    masks = [np.zeros(ROWS, np.int64) for _ in range(-(-len(langs) // MASK))]
    for w, mask in enumerate(masks):
        own = bits[bits["word"] == w]
        mask[own["slot"].to_numpy(np.int64)] = own["mask"].to_numpy(np.int64)
    fill = [(masks[i // MASK] >> i % MASK & 1).mean() for i in range(len(langs))]
    shares = np.array([of_lang[x] for x in langs], float)
    return Filters(langs, masks, np.array(fill) ** HASHES, shares / shares.sum())


def predict(texts: list[str], filters: Filters | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if filters is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    found, of, has = grams(texts)
    at = slots(found)
    total = np.bincount(of, minlength=len(texts))
    hits = np.zeros((len(filters.langs), len(texts)))
    for w, mask in enumerate(filters.masks):
        both = mask[at[0]]
        for more in at[1:]:
            both &= mask[more]
        for i in range(w * MASK, min((w + 1) * MASK, len(filters.langs))):
            hits[i] = np.bincount(of, both >> i % MASK & 1, len(texts))
    chance = filters.false[:, None]
    true = np.maximum((hits - total * chance) / np.maximum(1 - chance, 1e-9), 0)
    best = true.argmax(axis=0)
    top = true.max(axis=0)
    # Share of the grams that only the winner's lead over the next language explains.
    rest = np.sort(true, axis=0)[-2] if len(true) > 1 else np.zeros(len(texts))
    score = np.clip(0.5 + 0.5 * (top - rest) / np.maximum(top, 1e-9), 0, 1)
    # Without any hit, the language with most of the training text is the likeliest.
    best = np.where(top > 0, best, filters.shares.argmax())
    score = np.where(has, np.where(top > 0, score, filters.shares.max()), 0.0)
    return [filters.langs[b] if h else UNKNOWN for b, h in zip(best, has)], score


def identified(
    docs: DataFrame, filters: Filters | None, keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of those names.

    ``keep`` names the columns to return with them; all by default.
    """
    names = [c for c in keep or docs.columns if c not in ("lang_pred", "score")]
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, texts in _chunks(batch):
                a, b = predict(texts, shared.value)
                langs += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(langs, pa.string()),
                    pa.array(np.concatenate([np.zeros(0), *scores])),
                ],
                names=[*names, "lang_pred", "score"],
            )

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return map_arrow(docs.select(*dict.fromkeys([*names, "text"])), run, schema)


def language_digest(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """One row per document: its part of the split, the predicted language and a score."""
    aside = remainder(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), aside.alias("held_out"))
    training = rows.where("not held_out and lang is not null and text is not null")
    filters = learn(training)
    return identified(rows, filters, ["doc_id", "held_out"])
