"""Benchmark decontamination by word windows.

A window is ``size`` consecutive words of a benchmark item; a shorter item is one window. A
window of l words covers at least one whole block of (l + 1) // 2 words, counted from the
start of a document, wherever it lies. So a document is cut into blocks, each block is looked
up once in a broadcast hash set of the blocks of all windows, and a hit is verified against
the whole windows with the words around the block. Blocks without a hit never leave the task;
the shuffle carries one row per document and its verified hits.

The set is broadcast while its stored rows are at most ``BROADCAST_ROWS`` and its texts at most
``BROADCAST_BYTES``; a larger one is joined by shuffling the blocks, with equal results.

Defined cases: null and empty texts have no words and are clean. Items without words have no
windows. Equal items, and equal windows of several items, are found once and counted for each
item id; a null item id hits words but is not listed. Rows of documents that repeat are
decided once and returned as often as they come; null ids are told apart by their text. Extra
columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import ascii_lower, every, stored, words

# In lower-cased text: digits, a-z and everything beyond ASCII.
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def _text_key(text: Column) -> Column:
    """Tells apart the texts of rows with equal ids."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit(""))))


def _phrase(parts: Column, start: Column, length: Column | int) -> Column:
    """``length`` words from the zero-based ``start``, joined."""
    return F.array_join(F.slice(parts, start + 1, length), " ")


def _block(length: Column) -> Column:
    return F.floor((length + 1) / 2).cast("int")


def window_index(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``length, block, windows`` per distinct block of a window, stored.

    ``windows`` has the offset of the block, the whole window and the ids of its items.
    """
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"),
        words(ascii_lower(F.col("text")), BENCH_WORD).alias("words"),
    ).where("size(words) > 0")
    length = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    windows = (
        items.select("item_id", "words", length.alias("length"), F.explode(starts).alias("start"))
        .select("item_id", "length", _phrase(F.col("words"), F.col("start"), F.col("length")).alias("window"))
        .groupBy("length", "window")
        .agg(F.collect_set("item_id").alias("items"))
    )
    block = _block(F.col("length"))
    offsets = F.sequence(F.lit(0), F.col("length") - block)
    blocks = windows.select("*", F.explode(offsets).alias("offset")).select(
        "length",
        F.xxhash64(_phrase(F.split("window", " "), F.col("offset"), block)).alias("block"),
        F.struct("offset", "window", "items").alias("entry"),
    )
    return stored(
        blocks.groupBy("length", "block").agg(F.collect_list("entry").alias("windows")), "windows"
    )


def document_blocks(parts: Column, length: int) -> Column:
    """Blocks of a document's words for windows of ``length``: hash, place and surroundings."""
    block = (length + 1) // 2
    reach = length - block
    count = F.floor(F.size(parts) / block).cast("int")

    def one(k: Column) -> Column:
        start = k * block
        before = F.greatest(start - reach, F.lit(0))
        return F.struct(
            F.lit(length).alias("length"),
            F.xxhash64(_phrase(parts, start, block)).alias("block"),
            start.alias("start"),
            _phrase(parts, before, start + length - before).alias("around"),
        )

    last = F.greatest(count - 1, F.lit(0))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), last), one))


def _hits(columns: dict[str, Column]) -> Column:
    """Verified windows around a block that was found."""
    around = F.split(columns["around"], " ")
    start, length = columns["start"], columns["length"]
    before = F.greatest(start - (length - _block(length)), F.lit(0))

    def same(entry: Column) -> Column:
        first = start - entry["offset"]
        inside = F.greatest(first - before, F.lit(0))
        return (first >= 0) & (_phrase(around, inside, length) == entry["window"])

    def span(entry: Column) -> Column:
        return F.struct(
            (start - entry["offset"]).alias("start"),
            length.alias("length"),
            entry["items"].alias("items"),
        )

    return F.transform(F.filter(columns["windows"], same), span)


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted spans."""
    state = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        fresh = F.greatest(end - F.greatest(x["start"], s["end"]), F.lit(0))
        return F.struct(
            (s["words"] + fresh).cast("bigint").alias("words"),
            F.greatest(s["end"], end).alias("end"),
        )

    return F.aggregate(spans, state, step, lambda s: s["words"])


def found_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per distinct (``doc_id``, text): ``text_key, n_words, spans, items, copies``."""
    index = window_index(benchmark, size)
    bounds = index.agg(
        F.count("*").alias("rows"),
        F.sum(
            F.aggregate(
                "windows",
                F.lit(0).cast("bigint"),
                lambda n, w: n
                + F.length(w["window"])
                + F.aggregate(w["items"], F.lit(0), lambda m, i: m + F.length(i) + 8),
            )
        ).alias("bytes"),
        F.collect_set("length").alias("lengths"),
    ).first()
    small = bounds["rows"] <= BROADCAST_ROWS and (bounds["bytes"] or 0) <= BROADCAST_BYTES
    lengths = sorted(bounds["lengths"]) or [size]
    scanned = docs.select(
        "doc_id",
        _text_key(F.col("text")).alias("text_key"),
        words(ascii_lower(F.col("text")), BENCH_WORD).alias("words"),
    )
    parts = F.col("words")
    # One block that no window has stands for the document itself.
    itself = F.struct(
        F.lit(0).alias("length"),
        F.lit(0).cast("bigint").alias("block"),
        F.lit(-1).alias("start"),
        F.lit("").alias("around"),
    )
    every = F.concat(
        F.array(itself),
        *[F.coalesce(document_blocks(parts, n), F.array().cast("array<struct<length:int,block:bigint,start:int,around:string>>")) for n in lengths],
    )
    blocks = scanned.select("doc_id", "text_key", F.size(parts).alias("n_words"), F.inline(every))
    looked = blocks.join(F.broadcast(index) if small else index, ["length", "block"], "left")
    columns = {c: F.col(c) for c in ("around", "start", "length", "windows")}
    hits = looked.where("windows is not null or start = -1").select(
        "doc_id",
        "text_key",
        "n_words",
        (F.col("start") == -1).alias("itself"),
        F.coalesce(
            F.when(F.col("start") >= 0, _hits(columns)),
            F.array().cast("array<struct<start:int,length:int,items:array<string>>>"),
        ).alias("hits"),
    )
    bare = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length")))
    names = F.flatten(F.transform("hits", lambda h: h["items"]))
    return (
        hits.where("itself or size(hits) > 0")
        .groupBy("doc_id", "text_key", "n_words")
        .agg(
            F.count_if("itself").alias("copies"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set(bare)))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set(names)))).alias("items"),
        )
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: its words, the words hit, and the items found."""
    rows = found_spans(docs.select("doc_id", "text"), benchmark, size)
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    n_hit = _covered(F.col("spans"))
    return each.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE
) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without hit words.

    A removed word takes the separator after it along; ``n_chars`` is counted anew if there
    is such a column.
    """
    found = found_spans(docs.select("doc_id", "text"), benchmark, size).where("size(spans) > 0")
    hit = found.select(F.col("doc_id").alias("hit_id"), "text_key", "spans")
    rows = docs.select(F.struct(*every(docs)).alias("row"), _text_key(docs["text"]).alias("own_key"))
    same = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.col("own_key") == F.col("text_key"))
    if remove == "documents":
        return rows.join(hit, same, "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    text = F.col("row.text")
    # Words and separators in turn; the place of a word among the words is half its place.
    own = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(text, F.lit(rf"{own}|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    lead = F.when(text.rlike(f"^{own}"), 0).otherwise(1)

    def keep(piece: Column, i: Column) -> Column:
        word = F.floor((i - lead) / 2)
        return ~F.exists(
            "spans", lambda s: (word >= s["start"]) & (word < s["start"] + s["length"])
        )

    cleaned = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(F.filter(pieces, keep), ""))
    joined = rows.join(hit, same, "left").select("row", cleaned.alias("cleaned"))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.col("cleaned")
        elif c == "n_chars":
            fresh = F.length("cleaned").cast(docs.schema[c].dataType)
            value = F.when(F.col("cleaned") != F.col("row.text"), fresh).otherwise(value)
        columns.append(value.alias(c))
    return joined.select(*columns)
