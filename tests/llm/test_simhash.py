"""Fingerprints and their links against brute force."""

import random
import re

import xxhash

from tarmac.llm import simhash
from tarmac.llm.components import component_roots


def brute_print(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    n = min(size, len(words))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in parent}


def test_fingerprints_equal_the_definition():
    rng = random.Random(1)
    alphabet = ["the", "The", "é", "À", " x", "漢字", "a b", "K", "x" * 40]
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = "".join(rng.choice(alphabet) + rng.choice(" \t\n\x0b\x0c\r") for _ in range(n))
        assert simhash.fingerprint(text.encode(), 3) == brute_print(text)
    assert simhash.fingerprint(None, 3) == 0


def clouds(rng, n, flips):
    """Fingerprints that share most bits, so buckets crowd and chains form."""
    base = rng.getrandbits(64)
    found = {0, base}
    while len(found) < n:
        value = base
        for _ in range(rng.randint(0, flips)):
            value ^= 1 << rng.randrange(64)
        found.add(value)
    return sorted(found)


def test_bit_slices_find_every_link():
    rng = random.Random(2)
    for radius in (0, 1, 2, 3, 4):
        values = clouds(rng, 120, 6)
        links = simhash.within(values, radius)
        assert all((a ^ b).bit_count() <= radius for a, b in links)
        parent = {v: v for v in values}
        for a, b in links:
            parent = {k: (parent[a] if p == parent[b] else p) for k, p in parent.items()}
        want = brute_components(values, radius)
        assert len(set(parent.values())) == len(set(want.values())) == len(values) - len(links)


def test_crowded_buckets_split_without_losing_links(spark):
    rng = random.Random(3)
    values = clouds(rng, 700, 9)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    prints = spark.createDataFrame(signed, "fp long")
    want = brute_components(values, 2)
    for bucket in (8, 100_000):
        roots = component_roots(simhash.near_links(prints, 2, bucket=bucket))
        got = {r.node: r.root for r in roots.collect()}
        classes = {}
        for (fp,), value in zip(signed, values):
            classes.setdefault(want[value], set()).add(got.get(fp, fp))
        assert all(len(c) == 1 for c in classes.values())
        assert len(set.union(*classes.values())) == len(classes)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    roots = component_roots(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.root for r in roots.collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    roots = brute_components(set(prints.values()), 2)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_digest(docs).collect()}
    assert got == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_one_row_of_every_group_stays(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text, "a"), (2, text.upper(), "b"), (2, text, "c"), (2, text, "c"), (None, text, "d"), (9, "other words here", "e"), (None, "more of them", "f"), (None, "more of them", "f")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, note string")
    got = simhash.one_per_component(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["2", "9", "None"] and len(got) == 3
