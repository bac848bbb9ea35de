"""Token counts, benchmark windows, quality rules and licences."""

import random
import re

import compare
import duckdb
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tarmac.llm import decontaminate, licenses, quality_rules, token_counts
from tarmac.llm.oracle import ORACLE_SQL
from tarmac.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)


# --- token counts ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def test_counts_equal_the_library_on_noise(library):
    rng = random.Random(5)
    alphabet = " ▁ab\n\té漢字<s></s><unk><0x41>\x00123,.()À\U0001f600ﬁ　_#=theing  ².«»"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert token_counts.count_tokens(text, PATH) == len(library.encode(text)), repr(text)


@pytest.mark.parametrize("text", ["", " ", "   ", "abcdefgh" * 20_000, " " * 50_000, "漢字" * 5000, "a\n" * 9000])
def test_counts_equal_the_library_on_extremes(library, text):
    assert token_counts.count_tokens(text, PATH) == len(library.encode(text))


def test_counts_equal_the_library_on_documents(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, PATH, limit=1000).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text or ""))
        row = got[r.doc_id]
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len((r.text or "").encode()), n > 1000)


def test_best_rank_merges_first_and_ties_go_left():
    ranks = {c: 0.0 for c in "abc"} | {"bc": 1.0, "ab": 2.0, "abc": 3.0}
    assert token_counts.merged_count("abc", ranks) == 1
    ranks = {c: 0.0 for c in "ab"} | {"aa": 1.0, "aab": 2.0}
    assert token_counts.merged_count("aaab", ranks) == 3  # aa, a, b
    assert token_counts.merged_count("é", ranks) == 2


def test_a_full_cache_starts_again(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 3)
    counts = token_counts.SegmentCounts({"a": 0.0})
    assert [counts["a" * n] for n in range(1, 9)] == list(range(1, 9)) and len(counts) <= 3


# --- benchmark windows -------------------------------------------------------------------


def brute_hits(text, items, size=10):
    def words(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    own, hit, names = words(text), set(), set()
    for item, t in items:
        parts = words(t)
        n = min(size, len(parts))
        windows = {tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(item)
    return len(own), len(hit), sorted(names)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_windows_equal_brute_force(spark, monkeypatch, broadcast):
    """Also beyond the bound of the broadcast. Few words make near misses and overlaps."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(6)

    def text(n):
        return " ".join(rng.choice(["a", "B", "é"]) for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate([4, 5, 6, 7, 8, 9, 10, 11, 14])] + [(9, None), (10, "..")]
    docs = [(i, text(rng.randint(0, 90))) for i in range(60)] + [(100, items[8][1].upper()), (101, None)]
    got = decontaminate.contamination_digest(
        spark.createDataFrame(docs, "doc_id int, text string"),
        spark.createDataFrame(items, "item_id int, text string"),
    ).collect()
    want = {i: brute_hits(t, items) for i, t in docs}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == {
        i: (n, h, len(names)) for i, (n, h, names) in want.items()
    }
    assert sum(h for _, h, _ in want.values()) > 100


def test_removing_documents_and_spans(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before, {passage.upper()}; after.", 9), (2, "clean text", 10), (None, passage, 1), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int")
    bench = spark.createDataFrame([(1, passage)], "item_id int, text string")
    kept = decontaminate.without_benchmark(docs, bench).collect()
    assert sorted(map(tuple, kept)) == [(2, "clean text", 10), (3, None, None)]
    cut = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.without_benchmark(docs, bench, "spans").collect()}
    assert cut == {1: ("Before, after.", 14), 2: ("clean text", 10), None: ("", 0), 3: (None, None)}


# --- quality rules -----------------------------------------------------------------------


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 5))
    return len(hit)


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(0, 40)]
    texts += ["x\n\ny\nx\n x\n", "a b c d e\na b c d e", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = quality_rules.quality_digest(docs).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {i: brute_repeats(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_dup_lines for r in rows}[40] == 1


def test_policies_and_ablations_come_from_the_bits(spark, small):
    ledger = quality_rules.ledger(spark.read.parquet(f"{small}/documents.parquet"))
    failures = [r.failures for r in ledger.select("failures").collect()]
    for r in quality_rules.ablations(ledger).collect():
        everything = quality_rules.mask(quality_rules.POLICIES[r.policy])
        own = quality_rules.mask([r.rule])
        assert r.n_docs == len(failures)
        assert r.n_kept == sum(f & everything == 0 for f in failures)
        assert r.n_failed == sum(f & own != 0 for f in failures)
        assert r.n_kept_without == sum(f & everything & ~own == 0 for f in failures)


# --- licences ----------------------------------------------------------------------------


def licences_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r.licences for r in licenses.licence_digest(docs).collect()}


def test_sequences_are_matched_in_order(spark):
    grant, source, binary = (licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    texts = [
        f"{grant.upper()}:\n * {source};\nSomething else. {binary}.",
        f"{source}.\n{grant}.\n{binary}.",
        f"{grant}.\nAll rights reserved. {source}.\n{binary}.",
        "Licensed under the Apache License, Version 2.0!  released under THE MIT license",
        f"All rights reserved.\n{grant}.\n{source}.\n{binary}.",
    ]
    got = licences_of(spark, texts)
    assert got == {0: "BSD-2-Clause", 1: "", 2: "All-Rights-Reserved", 3: "Apache-2.0,MIT", 4: "BSD-2-Clause"}


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: \t

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""


BSD3 = BSD + """3. Neither the name of Example Inc. nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
""".replace("Inc. ", "Company ")
ISC = """ISC License

Copyright (c) 2020, A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
GPL2 = GPL.replace("version 3", "version 2")
LGPL = GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def commented(text, mark):
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())


@pytest.mark.parametrize("form", ["plain", "#", " *", "//", "crlf", "one line", "narrow"])
def test_wrapped_texts_give_their_licence(spark, form):
    def put(text):
        if form == "one line":
            return "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        if form == "narrow":
            return "\n\n".join("; \n".join("\n".join(p.split()).split(";\n")) for p in text.split("\n\n"))
        if form == "crlf":
            return text.replace("\n", "\r\n")
        return text if form == "plain" else f"/*\n{commented(text, form)} */\nint x;\n"

    other = GPL.replace("This program", "Foo Bar").replace("software:", "software;")
    texts = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-2-Clause": BSD, "GPL-3.0": GPL, "GPL-3.0 ": other}
    texts |= {"BSD-3-Clause": BSD3, "ISC": ISC, "GPL-2.0": GPL2, "LGPL-2.1": LGPL, "MPL-2.0": MPL}
    docs = spark.createDataFrame([(k, put(t)) for k, t in texts.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in licenses.licence_digest(docs).collect()}
    assert {k: r.licences for k, r in got.items()} == {k: k.strip() for k in texts}
    assert got["Apache-2.0"].sentence_ids == "notice-Apache-2.0,apache-comply,apache-copy"
    assert got["GPL-3.0"].sentence_ids == "gpl3-terms"


@pytest.mark.parametrize(
    "text, licences",
    [
        ("released under\n\nthe MIT license", ""),
        ("not released under\nthe MIT license", ""),
        ("This code is not\nreleased under the MIT license.", ""),
        ("This code is not\nMIT License", ""),
        ("released under\nthe MIT licenses", ""),
        ("Released under the\n# MIT license\nAll rights\nreserved", "MIT,All-Rights-Reserved"),
        ("This file is released under the MIT license.", "MIT"),
        ("MIT License\nCopyright 2020 Someone All rights reserved\nfoo", "MIT"),
        ("// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x;", "Apache-2.0,MIT"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", "GPL-2.0"),
        ("# SPDX-License-Identifier: (MPL-2.0 AND BSD-3-Clause)", "BSD-3-Clause,MPL-2.0"),
        ("Apache License\nVersion 2.0, January 2004\nApache", "Apache-2.0"),
        ("Mozilla Public License Version 2.0\n=====", "MPL-2.0"),
        ("MIT\nLICENSE", "MIT"),
        ("été\nà MIT License", ""),
    ],
)
def test_notices_titles_and_identifiers(spark, text, licences):
    assert licences_of(spark, [text]) == {0: licences}


def test_columns_of_any_name_stay_or_are_replaced(spark):
    docs = spark.createDataFrame([("MIT License", 1, 2)], "text string, `a.b` int, LICENCES int")
    out = licenses.with_licences(docs)
    assert out.columns == ["text", "a.b", "n_sentences", "sentence_ids", "licences"]
    assert out.first().asDict() == {
        "text": "MIT License", "a.b": 1, "n_sentences": 1, "sentence_ids": ["mit-title"], "licences": ["MIT"]
    }


def test_sql_agrees_on_licence_texts(spark, tmp_path):
    whole = [APACHE, MIT, BSD, BSD3, GPL, GPL2, LGPL, ISC, MPL, None, ""]
    texts = whole + ["\n".join(map(str, whole)), "MIT License\nMIT License\nNot\nMIT License\n" * 3]
    texts += [commented(t, "#") for t in whole if t] + ["x SPDX-License-Identifier: MIT AND ISC\n_\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert compare.spark_rows(licenses.licence_digest(docs)) == compare.oracle_rows(con, ORACLE_SQL["op9_license_scan"])
