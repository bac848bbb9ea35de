"""Secret spans and the ledger."""

import hashlib
import re

import pytest

from tarmac.llm import secrets

TEXTS = [
    "API_KEY: 'abcd1234efgh' and Token=short and paſſword=abcdefgh12 toKen=abcdefgh12",
    "é\U0001f600 passwd = \"p4ss/word+9\" AKIAABCDEFGHIJKL and " + "0123456789abcdef" * 2 + "f",
    "secret:a/token:abcdefghij",
    "AKIAAKIA AKIA1234567890AB AKIA " + "a" * 31 + " " + "b" * 32,
    "",
    None,
]


def brute(text):
    """The base kinds by the contract's own patterns."""
    kinds = [
        ("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ]
    spans = []
    for place, (kind, pattern, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(group)) >= least:
                spans.append((m.start(), place, m.end(), kind))
    return sorted(spans)


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = {r.doc_id: r for r in secrets.secret_digest(docs).collect()}
    assert sum(len(brute(t)) for t in TEXTS) >= 6
    for i, text in enumerate(TEXTS):
        spans = brute(text)
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert rows[i].n_hex == sum(k == "hex" for *_, k in spans)
        assert set(line.split(",")) - {""} <= set(rows[i].spans.split(","))


def test_added_kinds(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "A1" * 18
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    spans = secrets.secret_digest(docs).first().spans
    assert spans.split(",")[0] == "pem:0:31" and "provider:32:" in spans


def test_ledger_scans_only_what_it_lacks(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id int, text string")
    first = secrets.scan(docs)
    assert first.select("blob").distinct().count() == 2
    assert first.count() == 2 * len(secrets.RULES)
    more = spark.createDataFrame([(4, "x"), (5, "z")], "doc_id int, text string")
    second = secrets.scan(docs.union(more), first)
    assert second.select("blob").distinct().count() == 1
    newer = [secrets.Rule("hex", 2, r"[0-9a-f]{16,}", 16), *secrets.RULES]
    third = secrets.scan(docs, first, newer)
    assert {(r.rule, r.version) for r in third.collect()} == {("hex", 2)}


def test_every_path_of_a_blob_gets_its_findings(spark):
    rows = [(i, "token=abcdefgh99") for i in range(300)] + [(None, "token=abcdefgh99")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = secrets.secret_digest(docs).collect()
    assert len(got) == 301 and {r.n_assign for r in got} == {1}


def test_redaction(spark):
    rows = [(1, "é token=abcdefgh99 x", 20), (2, "clean", 5), (3, None, None), (4, "password=token=abcdefgh1", 24)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(docs, secrets.scan(docs)).collect()}
    assert got == {1: ("é [SECRET] x", 12), 2: ("clean", 5), 3: (None, None), 4: ("[SECRET]", 8)}


BODY = ["MIIEpAIBAAKCAQEA" + "aB3+/x7Z" * 6, "q9Rt" * 16, "AQAB=="]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize(
    "key",
    [
        "\n".join([BEGIN, *BODY, END]),
        "\r\n".join([BEGIN, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0F", "", *BODY, END]),
        "\\n".join([BEGIN, *BODY, END]),
        " ".join([BEGIN, *BODY, END]),
        "\n".join([BEGIN, "# not base64, - and --", *BODY, END]),
        "\n".join([BEGIN, *BODY]),
        "\r\n".join([BEGIN, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0F", "", *BODY]),
        "\\n".join([BEGIN, *BODY]),
        "\n> ".join([BEGIN, *BODY]),
        "\\n\" +\n  \"".join([BEGIN, *BODY]),
        "\n".join([BEGIN, *BODY[:2]]) + "\n" + BEGIN + "\n" + "\n".join(BODY),
    ],
)
def test_redaction_leaves_no_part_of_a_key(spark, key):
    text = f"é before\n{key}\nSome words, and password reset.\n"
    docs = spark.createDataFrame([(1, text), (2, key)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(docs, secrets.scan(docs)).collect()}
    for line in [*BODY, "PRIVATE KEY"]:
        assert line not in got[1] and line not in got[2]
    assert got[1].startswith("é before\n[SECRET]") and "[SECRET]\nSome words, and password reset.\n" in got[1]
    spans = {r.doc_id: r.spans for r in secrets.secret_digest(docs).collect()}
    if key.count("BEGIN") == 1:
        assert f"pem:0:{len(key)}" in spans[2].split(",")


def test_a_key_ends_before_text_and_other_blocks():
    rule = next(r for r in secrets.RULES if r.kind == "pem")

    def spans(text):
        return secrets.find(rule, re.compile(rule.pattern), text, text.lower())

    n = len(BEGIN)
    assert spans(f"{BEGIN} is a header\nand no key follows") == [(0, n)]
    assert spans(f"{BEGIN}\n-----BEGIN CERTIFICATE-----\nAAAA\n{END}") == [(0, n)]
    two = "\n".join([BEGIN, *BODY, END])
    assert spans(two + "\nx\n" + two) == [(0, len(two)), (len(two) + 3, 2 * len(two) + 3)]


def test_many_open_keys_take_time_in_proportion():
    rule = next(r for r in secrets.RULES if r.kind == "pem")
    pattern = re.compile(rule.pattern)
    for text in (BEGIN * 50_000, (BEGIN + "\n") * 50_000, BEGIN + " \n" * 500_000, BEGIN + "\nab -" * 500_000):
        assert secrets.find(rule, pattern, text, text.lower())
