"""Scores by a context-tree-weighting model of bytes.

A text is its lower-cased words with one space between and a line end after the last. Each
byte is eight binary decisions; a decision has a node in the tree of the previous 0 to
``DEPTH`` bytes. Every node holds the Krichevsky-Trofimov estimate of its counts in the
training texts, and weighting mixes the estimates of all depths: a node's weight is the
posterior that its context should not be refined, from the block probabilities of its subtree.
The logarithms of the mixed probabilities add up to the code length of a text.

Counts are gathered from all texts: one row per distinct byte string of ``DEPTH + 1`` and
task, summed by Spark, then summed upwards to shorter contexts and mixed downwards again, one
join per depth with at most 256 rows per key. Texts meet the model without leaving their task:
the frequent strings, chosen by a count threshold so that at most ``FREQUENT_STRINGS`` reach
it, go to every worker; the rest of the strings of a document are matched by a join. Words of
the unigram baseline are handled in the same way. Tables of strings, nodes and documents grow
with the corpus, and their files are far smaller than their rows in memory, so joins with them
are merge joins and never left to the broadcast threshold.

Defined cases: null and empty texts are one line end, one token. A null id hashes as empty
text. Without training texts every bit has probability one half and the baseline probability
is one. Repeated rows keep their rows. Only the id and the text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import map_arrow, remainder, stored

DEPTH = 5
# Bounds of the tables that every worker holds.
FREQUENT_STRINGS, FREQUENT_WORDS = 1 << 20, 1 << 19
# Bounds of what a task gathers before it sends rows on.
GATHERED_BYTES, GATHERED_STRINGS, GATHERED_WORDS = 1 << 21, 1 << 22, 300_000
END = ""


def line_of(text: bytes | None) -> tuple[list[bytes], bytes]:
    """Words in lower case, and the line that is modelled. ``bytes`` split by ASCII rules."""
    found = text.lower().split() if text else []
    return found, b" ".join(found) + b"\n"


def strings(lines: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the ``depth`` bytes before it, as a number, and its line."""
    pad = b"\n" * depth
    data = pad.join([b"", *lines]) + bytes(8)
    lengths = np.array([len(x) for x in lines], np.int64)
    owner = np.repeat(np.arange(len(lines)), lengths)
    # The eight bytes from every place on, as a number; a string is the first depth + 1.
    # The first place of a line lies after the lines before it and the pads between them.
    count = int(lengths.sum()) + depth * max(len(lines) - 1, 0)
    eight = np.ndarray(count, ">u8", data, strides=(1,)).astype(np.uint64)
    eight >>= np.uint64(56 - 8 * depth)
    turns = np.column_stack([lengths, np.full_like(lengths, depth)]).ravel()
    inside = np.repeat(np.arange(len(turns)) % 2 == 0, turns)[:count]
    found = eight[inside].view(np.int64)
    return found, owner


def gathered(docs: DataFrame, depth: int) -> DataFrame:
    """``word, string, trained, seen``: counts over all texts; stored.

    ``docs`` has ``text`` and ``train``. A row has a word or a string; the end of a text is
    the empty word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        lines: list[bytes] = []
        flags: list[bool] = []
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        size = held = 0
        for batch in batches:
            texts, train = batch.column("text"), batch.column("train").to_pylist()
            for text, flag in zip(texts.cast(pa.binary()), train):
                parts, line = line_of(text.as_py())
                if flag:
                    found.update(parts)
                    found[b""] += 1
                lines.append(line)
                flags.append(flag)
                size += len(line)
                if size >= GATHERED_BYTES:
                    pieces.append(_counted(lines, flags, depth))
                    held += len(pieces[-1][0])
                    lines, flags, size = [], [], 0
                if len(found) >= GATHERED_WORDS:
                    yield from _word_rows(found)
                    found = Counter()
                if held >= GATHERED_STRINGS:
                    pieces = [_merged(pieces)]
                    held = len(pieces[0][0])
                    if held >= GATHERED_STRINGS // 2:
                        yield from _string_rows(*pieces[0])
                        pieces, held = [], 0
        if lines:
            pieces.append(_counted(lines, flags, depth))
        yield from _word_rows(found)
        if pieces:
            yield from _string_rows(*_merged(pieces))

    rows = map_arrow(docs, run, "word binary, string long, trained long, seen long")
    return stored(
        rows.groupBy("word", "string").agg(
            F.sum("trained").alias("trained"), F.sum("seen").alias("seen")
        ),
        "counts",
    )


def _counted(lines: list[bytes], flags: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings and their counts; the lowest bit of a string tells training texts."""
    found, owner = strings(lines, depth)
    return np.unique(found << 1 | np.array(flags, np.int64)[owner], return_counts=True)


def _merged(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by string; the pieces are sorted, which a stable sort makes use of."""
    keys = np.concatenate([keys for keys, _ in pieces])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(np.concatenate([n for _, n in pieces])[order], first)


def _word_rows(found: Counter) -> Iterator[pa.RecordBatch]:
    counts = pa.array(list(found.values()), pa.int64())
    empty = pa.nulls(len(found), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.binary()), empty, counts, counts],
        names=["word", "string", "trained", "seen"],
    )


def _string_rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays(
        [
            pa.nulls(len(keys), pa.binary()),
            pa.array(keys >> 1),
            pa.array(np.where(keys & 1, counts, 0)),
            pa.array(counts),
        ],
        names=["word", "string", "trained", "seen"],
    )


# --- the tree ----------------------------------------------------------------------------


def _ln_gamma(x: Column) -> Column:
    """ln Gamma by Stirling's series after seven steps up."""
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    return (z - 0.5) * F.ln(z) - z + float(0.5 * np.log(2 * np.pi)) + series - F.ln(product)


def _block_log(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a block with these counts."""
    return (
        _ln_gamma(zeros + 0.5)
        + _ln_gamma(ones + 0.5)
        - _ln_gamma(zeros + ones + 1.0)
        - float(np.log(np.pi))
    )


def _decisions(grams: DataFrame, *columns: str) -> DataFrame:
    """Eight rows per string: the node (context, then the bits so far) and the bit."""
    byte = F.col("string").bitwiseAND(255)
    cases = [
        F.struct(
            (
                F.shiftleft(F.shiftright("string", 8), 8)
                + (1 << b)
                + F.shiftright(byte, 8 - b)
            ).alias("node"),
            F.shiftright(byte, 7 - b).bitwiseAND(1).cast("double").alias("bit"),
        )
        for b in range(8)
    ]
    return grams.select("string", *columns, F.inline(F.array(*cases)))


def node_levels(grams: DataFrame, depth: int) -> list[DataFrame]:
    """Per depth ``node, zeros, ones, stop``: counts, and the weight of the node's own estimate.

    ``stop`` is the posterior of the node against the product of its children, 1 at the
    deepest level. Nodes of longer contexts have their oldest byte first.
    """
    bits = _decisions(grams, "trained")
    ones = F.col("bit") * F.col("trained")
    level = bits.groupBy("node").agg(
        F.sum(F.col("trained") - ones).alias("zeros"), F.sum(ones).alias("ones")
    )
    own = _block_log(F.col("zeros"), F.col("ones"))
    level = stored(level.select("*", own.alias("weighted"), F.lit(1.0).alias("stop")), "nodes")
    levels = [level]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1).cast("bigint"))
        sums = level.groupBy(shorter.alias("node")).agg(
            F.sum("zeros").alias("zeros"),
            F.sum("ones").alias("ones"),
            F.sum("weighted").alias("refined"),
        )
        own, refined = F.col("own"), F.col("refined")
        most = F.greatest(own, refined)
        mixed = most + F.ln(F.exp(own - most) + F.exp(refined - most)) - float(np.log(2))
        level = stored(
            sums.withColumn("own", _block_log(F.col("zeros"), F.col("ones"))).select(
                "node",
                "zeros",
                "ones",
                mixed.alias("weighted"),
                (1 / (1 + F.exp(refined - own))).alias("stop"),
            ),
            "nodes",
        )
        levels.insert(0, level)
    return levels


def mixed_probabilities(levels: list[DataFrame]) -> DataFrame:
    """``node, one``: the probability of a 1 at the deepest nodes, mixed over all depths.

    Read from the root down: what earlier depths have settled, and the weight that is left.
    """
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    settled, left = F.col("stop") * estimate, 1 - F.col("stop")
    path = levels[0].select("node", settled.alias("settled"), left.alias("left"))
    for d, level in enumerate(levels[1:], 1):
        parent = F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1).cast("bigint"))
        above = path.select(
            F.col("node").alias("parent"),
            F.col("settled").alias("before"),
            F.col("left").alias("open"),
        )
        path = stored(
            level.withColumn("parent", parent)
            .join(above.hint("merge"), "parent")
            .select(
                "node",
                (F.col("before") + F.col("open") * settled).alias("settled"),
                (F.col("open") * left).alias("left"),
            ),
            "mixed",
        )
    return path.select("node", F.col("settled").alias("one"))


def string_scores(grams: DataFrame, depth: int) -> DataFrame:
    """``string, seen, score``: log10 of the probability of each string's last byte; stored."""
    one = mixed_probabilities(node_levels(grams, depth))
    chance = F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one"))
    scores = (
        _decisions(grams, "seen")
        .join(one.hint("merge"), "node")
        .groupBy("string", "seen")
        .agg(F.sum(F.log10(chance)).alias("score"))
    )
    return stored(scores, "scores")


# --- texts against the model -------------------------------------------------------------


def frequent(rows: DataFrame, bound: int) -> DataFrame:
    """The rows with the largest ``seen``: all from the lowest power of two on that leaves at
    most ``bound``. Every other row is matched by a join."""
    power = F.floor(F.log2(F.col("seen"))).cast("int").alias("power")
    counts = sorted(rows.groupBy(power).count().collect(), reverse=True)
    total, least = 0, 64
    for row in counts:
        total += row["count"]
        if total > bound:
            break
        least = row["power"]
    return rows.where(F.col("seen") >= F.lit(float(2**least)))


def _first_pass(docs: DataFrame, words: pa.Table, grams: pa.Table, depth: int) -> DataFrame:
    """Documents with the part of their scores the frequent tables give, and what they lack.

    Rows with ``n_tokens`` are documents; the others have a missing word or string. Stored, so
    that a row keeps its number.
    """
    context = docs.sparkSession.sparkContext
    frequent_words = context.broadcast(words)
    frequent_strings = context.broadcast(grams)
    names = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score",
             "word", "string", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, every = frequent_words.value, frequent_strings.value
        logs = np.log10(known["trained"].to_numpy() + 1.0).tolist()
        table = dict(zip(known["word"].to_pylist(), logs))
        index = pd.Index(every["string"].to_numpy())
        scores = np.append(every["score"].to_numpy(), 0.0)
        for batch in batches:
            for piece in _pieces(batch):
                yield from score(piece, table, index, scores)

    def score(piece, table, index, scores):
        rows = piece.column("row").to_pylist()
        lines, tokens, known, base = [], [], [], []
        lost_words: list[tuple[int, bytes, int]] = []
        for row, text in zip(rows, piece.column("text").cast(pa.binary())):
            parts, line = line_of(text.as_py())
            parts.append(b"")
            got = list(map(table.get, parts))
            missed = got.count(None)
            if missed:
                lost = Counter(w for w, x in zip(parts, got) if x is None)
                lost_words += [(row, w, n) for w, n in lost.items()]
            lines.append(line)
            tokens.append(len(parts))
            known.append(len(parts) - missed)
            # Logarithms of counts above one are never zero.
            base.append(sum(filter(None, got)))
        found, owner = strings(lines, depth)
        place = index.get_indexer(found)
        sums = np.bincount(owner, scores[place], len(lines))
        missing = place < 0
        pairs = pd.DataFrame({"at": owner[missing], "string": found[missing]})
        lost = pairs.groupby(["at", "string"], sort=False).size().reset_index(name="times")
        n, w, s = len(lines), len(lost_words), len(lost)
        number = np.array(rows, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([number, [x[0] for x in lost_words], number[lost["at"]]]).astype(np.int64)),
                pa.concat_arrays([piece.column("doc_id"), pa.nulls(w + s, piece.column("doc_id").type)]),
                pa.concat_arrays([piece.column("held_out"), pa.nulls(w + s, pa.bool_())]),
                pa.array(tokens + [None] * (w + s), pa.int64()),
                pa.array([len(x) for x in lines] + [None] * (w + s), pa.int64()),
                pa.array(known + [None] * (w + s), pa.int64()),
                pa.array([float(x) for x in base] + [None] * (w + s), pa.float64()),
                pa.array(list(sums) + [None] * (w + s), pa.float64()),
                pa.array([None] * n + [x[1] for x in lost_words] + [None] * s, pa.binary()),
                pa.array([None] * (n + w) + lost["string"].tolist(), pa.int64()),
                pa.array([None] * n + [x[2] for x in lost_words] + lost["times"].tolist(), pa.int64()),
            ],
            names=names,
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_bytes long, n_known long, "
        "base double, score double, word binary, string long, times long"
    )
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    return stored(map_arrow(numbered, run, schema), "first")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a few megabytes of text each; a longer text is a slice alone."""
    sizes = [len(x.as_py() or "") for x in batch.column("text")]
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > GATHERED_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def lm_scores(docs: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """One row per document: counts, the unigram baseline and the model's log10 probability.

    Learns from the documents for which ``held_out`` is false.
    """
    texts = docs.select("doc_id", "text", held_out.alias("held_out"))
    counts = gathered(texts.select("text", (~F.col("held_out")).alias("train")), depth)
    words = counts.where("word is not null and trained > 0").select("word", "trained", "seen")
    grams = counts.where("string is not null").select("string", "trained", "seen")
    size = words.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    scores = string_scores(grams, depth)
    first = _first_pass(
        texts,
        frequent(words, FREQUENT_WORDS).select("word", "trained").toArrow(),
        frequent(scores, FREQUENT_STRINGS).select("string", "score").toArrow(),
        depth,
    )
    of_words = (
        first.where("word is not null")
        .select("row", "word", "times")
        .join(words.select("word", "trained").hint("merge"), "word")
        .groupBy("row")
        .agg(
            F.sum("times").alias("more_known"),
            F.sum(F.col("times") * F.log10(F.col("trained") + 1.0)).alias("more_base"),
        )
    )
    of_strings = (
        first.where("string is not null")
        .select("row", "string", "times")
        .join(scores.select("string", F.col("score").alias("each")).hint("merge"), "string")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("each")).alias("more_score"))
    )
    # N + V + 1 of the add-one estimate.
    space = float(np.log10(float(size["n"] + size["v"] + 1)))
    zero = F.lit(0.0)
    score = F.col("score") + F.coalesce("more_score", zero)
    return (
        first.where("n_tokens is not null")
        .select("row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score")
        .join(of_words.hint("merge"), "row", "left")
        .join(of_strings.hint("merge"), "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(size["n"]).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * space).alias("base_score"),
            score.alias("score"),
            (-score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
        )
    )


def lm_digest(docs: DataFrame) -> DataFrame:
    return lm_scores(docs, remainder(F.col("doc_id"), 7) == 2)
