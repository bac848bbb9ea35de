"""Classifier, language identification and language model: held-out quality and brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import language_id, lm_score, quality_model
from tarmac.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


# --- quality classifier ------------------------------------------------------------------


@pytest.fixture(scope="module")
def scores(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    return QUERIES["op4_quality_model"](spark, MEDIUM).join(labels, "doc_id").toPandas()


def test_held_out_documents_are_told_apart(scores):
    held = scores[scores.held_out]
    right = (held.predicted == held.quality).mean()
    assert right >= 0.95 and (held.quality == 0).sum() >= 10
    ranks = held.score.rank()
    good = held.quality == 1
    auc = (ranks[good].mean() - (good.sum() + 1) / 2) / (~good).sum()
    assert auc >= 0.97


def test_scores_are_calibrated_probabilities(scores):
    held = scores[scores.held_out]
    assert held.score.between(0, 1).all()
    assert abs(held.score.mean() - held.quality.mean()) < 0.06


def test_labels_of_held_out_documents_are_not_learned(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    kept = quality_model.training_labels(labels).join(labels, "doc_id")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    assert kept.where(crc == 1).count() == 0 < kept.count()


def test_contexts_equal_the_definition():
    places, signs = quality_model.index_vectors()
    ids = [3, 5, 3, 9, 3, quality_model.BUCKETS, quality_model.BUCKETS, 5]
    sums = np.zeros((quality_model.BUCKETS + 1) * quality_model.DIM)
    quality_model.add_contexts(ids, sums, places, signs)
    want = np.zeros((quality_model.BUCKETS + 1, quality_model.DIM))
    for i, here in enumerate(ids):
        for j, there in enumerate(ids):
            if 0 < abs(i - j) <= quality_model.WINDOW and there < quality_model.BUCKETS:
                for p, s in zip(places[there], signs[there]):
                    want[here, p] += s
    assert (sums.reshape(want.shape) == want).all()


def test_without_labels_everything_is_accepted(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    labels = spark.createDataFrame([], "doc_id int, label int")
    row = quality_model.classify(docs, labels).first()
    assert (row.score, row.predicted) == (0.5, 1)


# --- language identification -------------------------------------------------------------


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language_id"](spark, MEDIUM).join(docs, "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.98
    assert got.where("score < 0 or score > 1").count() == 0


def test_texts_without_letters_are_undetermined(spark):
    rows = [(1, "hello there world", "en"), (2, "guten morgen welt", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_digest(docs, F.lit(False)).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert {got[i].score for i in (3, 4, 5)} == {0.0}
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "de")


def test_filters_answer_for_all_languages_at_once(spark):
    """More languages than bits in a mask; every gram of a language hits its filter."""
    rng = random.Random(4)
    rows = [(f"l{i:02d}", "".join(rng.choice("abcdefghijkl") for _ in range(60))) for i in range(70)]
    filters = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert len(filters.masks) == 2 and len(filters.langs) == 70
    langs, _ = language_id.predict([t for _, t in rows], filters)
    assert langs == [lang for lang, _ in rows]
    found, _, _ = language_id.grams([rows[69][1]])
    mask = filters.masks[1]
    assert all((mask[at] >> 69 % language_id.MASK & 1).all() for at in language_id.slots(found))


def test_grams_do_not_cross_texts():
    found, of, has = language_id.grams(["ab", "", "c d", "\U0001f600é"])
    one, _, _ = language_id.grams(["ab"])
    assert set(one) <= set(found) and list(has) == [True, False, True, True]
    assert len(found[of == 0]) == len(one) == 1


# --- language model ----------------------------------------------------------------------


def brute_ctw(train, texts, depth):
    """Context-tree weighting written out: a tree of counts and a recursion over it."""
    counts = {}

    def line(text):
        return b" ".join((text or "").encode().lower().split()) + b"\n"

    def bits(data):
        padded = b"\n" * depth + data
        for i, byte in enumerate(data):
            context = padded[i : i + depth]
            node = 1
            for b in range(7, -1, -1):
                bit = byte >> b & 1
                yield context, node, bit
                node = node << 1 | bit

    for text in train:
        for context, node, bit in bits(line(text)):
            for d in range(depth + 1):
                counts.setdefault((context[depth - d :], node), [0, 0])[bit] += 1

    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = block(*counts.get((context, node), (0, 0)))
            if len(context) < depth:
                below = sum(
                    weighted(bytes([x]) + context, node)
                    for x in range(256)
                    if (bytes([x]) + context, node) in counts
                )
                top = max(own, below)
                own = top + math.log((math.exp(own - top) + math.exp(below - top)) / 2)
            memo[(context, node)] = own
        return memo[(context, node)]

    def one(context, d, node):
        here = context[depth - d :]
        a, b = counts.get((here, node), (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == depth:
            return estimate
        stop = math.exp(math.log(0.5) + block(a, b) - weighted(here, node))
        return stop * estimate + (1 - stop) * one(context, d + 1, node)

    result = []
    for text in texts:
        total = 0.0
        for context, node, bit in bits(line(text)):
            p = one(context, 0, node)
            total += math.log10(p if bit else 1 - p)
        result.append(total)
    return result


TEXTS = ["The cat sat on the mat", "the Cat ate the rat", "a mat is a mat", "", None, "Über die Matte", "zzz unseen qx", "the the the the"]


@pytest.mark.parametrize("bound", [1 << 20, 8, 0])
def test_scores_equal_brute_force(spark, monkeypatch, bound):
    """With few or no frequent strings and words, joins give the same scores."""
    monkeypatch.setattr(lm_score, "FREQUENT_STRINGS", bound)
    monkeypatch.setattr(lm_score, "FREQUENT_WORDS", bound)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(lm_score.lm_scores(docs, F.col("doc_id") >= 5, depth=2).collect())
    want = brute_ctw(TEXTS[:5], TEXTS, 2)
    assert [r.score for r in got] == pytest.approx(want, rel=1e-7)

    tokens = [(t or "").encode().lower().split() + [b""] for t in TEXTS]
    counts = Counter(w for ws in tokens[:5] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r, ws in zip(got, tokens):
        assert (r.n_tokens, r.n_known) == (len(ws), sum(w in counts for w in ws))
        assert r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))


def test_without_training_texts_every_bit_is_open(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id int, text string")
    row = lm_score.lm_scores(docs, F.lit(True)).first()
    assert row.bits_per_byte == pytest.approx(8) and row.base_score == 0 and row.train_tokens == 0


def test_the_model_beats_the_unigram_baseline_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    row = lm_score.lm_digest(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def brute_force_language(text, training):
    """Grams looked up in plain sets, with the same rates; no filter, so no chance hits."""

    def grams_of(value):
        kept = " " + "".join(c if c.isalpha() else " " for c in value.lower()) + " "
        kept = " " + " ".join(kept.split()) + (" " if kept.split() else "")
        return [kept[i : i + 4] for i in range(len(kept) - 3)]

    counts = {lang: Counter(g for t in texts for g in grams_of(t)) for lang, texts in training.items()}
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    rate = {lang: {g: n / totals[lang] for g, n in c.items()} for lang, c in counts.items()}
    every = Counter()
    for r in rate.values():
        every.update(r)
    owned = {
        lang: {g for g, x in r.items() if x >= language_id.MIN_RATE and x >= language_id.MIN_SHARE * every[g]}
        for lang, r in rate.items()
    }
    if not any(c.isalpha() for c in text):
        return "und"
    hits = {lang: sum(g in own for g in grams_of(text)) for lang, own in owned.items()}
    if not any(hits.values()):
        return max(sorted(totals), key=totals.get)
    return max(sorted(hits), key=hits.get)


def test_language_equals_brute_force(spark):
    training = {
        "aa": ["the cat sat on the mat and the dog ran", "a house with the garden"],
        "bb": ["der hund lief und die katze schlief im haus", "ein garten mit dem haus" * 5],
        "cc": ["\U00010400\U00010401\U00010402\U00010403 \U00010404\U00010400\U00010401"],
    }
    rows = [(lang, t) for lang, texts in training.items() for t in texts]
    filters = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    texts = [
        "the mat",
        "im Haus!",
        "\U00010400\U00010401\U00010402\U00010403",
        "\U0001f600\U0001f601 ☃",
        "漢字漢字漢字",
        "123",
        "",
        None,
        "the haus",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identified(docs, filters).collect()}
    for i, text in enumerate(texts):
        assert got[i][0] == brute_force_language(text or "", training), text
        assert 0 <= got[i][1] <= 1
    assert got[3] == ("und", 0.0) and got[2][0] == "cc" and got[4][0] == "bb"
