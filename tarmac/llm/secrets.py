"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds one row
per (blob, rule, version) that was ever scanned, with the spans found, so a run reads only
the blobs of which a rule version is missing, each once however many paths hold it. Findings
join back to every path. Only blob addresses meet in shuffles by blob; texts move once, dealt
by blob and holder, so a group of copies does not gather in one task.

Defined cases: a null text is scanned as empty text. A null id is a path of its own. Repeated
rows each get their result. Offsets count code points, ends are exclusive. Columns other than
the id and the text are not read; ``redacted`` returns them unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import every, map_pandas, stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters.

    ``hints`` are strings of which the text, in lower case, must hold one for a match.
    """

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0
    hints: tuple[str, ...] = ()


# Letters of the key words match in either case; re.ASCII keeps that to ASCII letters.
KEYWORDS = r"(password|passwd|secret|token|api_?key)"
# A private key goes from its BEGIN line through the next END line of a private key. Without
# one before another BEGIN or END line it goes over the lines of base64 that follow, and over
# the head of an encrypted key before them. Line ends may be written as escapes, in quotes or
# behind comment marks; a long run of base64 needs none.
_BEGIN = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_CLOSED = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
_MARKS = r"[ \t\"'>#*,]*+"
_BREAK = rf"(?:{_MARKS}(?:\\[rn]|[\r\n]))"
_GAP = rf"(?:{_BREAK}++{_MARKS}(?:\+ ?[\"'])?|[ \t]++(?=[A-Za-z0-9+/=]{{32}}))"
_HEAD = rf"(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+"
_LINE = rf"{_GAP}(?:[A-Za-z0-9+/=]{{32,}}+|[A-Za-z0-9+/=]++(?={_BREAK}|{_MARKS}\Z))"
PEM = rf"{_BEGIN}(?:{_CLOSED}|{_HEAD}(?:{_LINE})++|)"
RULES = (
    Rule(
        "assign",
        1,
        rf"(?ai:{KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        8,
        2,
        ("password", "passwd", "secret", "token", "api"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, 0, ("akia",)),
    # A run of 32 or more is found from its first character on, as with "+" and a length.
    Rule("hex", 1, r"[0-9a-f]{32,}", 32),
    Rule("pem", 2, PEM, 1, 0, ("private key",)),
    Rule("provider", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abp]-[A-Za-z0-9-]{10,})", 1, 0,
         ("gho_", "ghp_", "ghr_", "ghs_", "ghu_", "xox")),
)
BASE = ("assign", "access", "hex")

LEDGER = "blob binary, rule string, version int, starts array<int>, ends array<int>"


def find(rule: Rule, pattern: re.Pattern, text: str, lower: str) -> list[tuple[int, int]]:
    """Spans of one rule in one whole text."""
    if rule.hints and not any(h in lower for h in rule.hints):
        return []
    return [
        m.span()
        for m in pattern.finditer(text)
        if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def pending(paths: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """``blob, holder, rules``: what no earlier run has scanned, and a path that has it."""
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        return blobs.withColumn("rules", wanted)
    pairs = blobs.select("blob", "holder", F.inline(wanted))
    unseen = pairs.join(ledger, ["blob", "rule", "version"], "left_anti")
    return unseen.groupBy("blob", "holder").agg(F.collect_list(F.struct("rule", "version")).alias("rules"))


def scan(
    docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """New ledger rows, stored: one per unseen pair of blob and rule version."""
    versions = docs.select("doc_id", address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    todo = pending(versions.select("doc_id", "blob"), ledger, rules)
    same = F.col("v.blob").eqNullSafe(F.col("t.blob")) & F.col("v.doc_id").eqNullSafe(F.col("t.holder"))
    texts = versions.alias("v").join(todo.alias("t"), same).select("v.blob", "text", "rules")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {(r.kind, r.version): (r, re.compile(r.pattern)) for r in rules}
        for frame in frames:
            rows = []
            for blob, text, unseen in zip(frame["blob"], frame["text"], frame["rules"]):
                lower = text.lower()
                for pair in unseen:
                    rule, pattern = compiled[pair["rule"], pair["version"]]
                    spans = find(rule, pattern, text, lower)
                    starts, ends = [s for s, _ in spans], [e for _, e in spans]
                    rows.append((blob, rule.kind, rule.version, starts, ends))
            yield pd.DataFrame(rows, columns=["blob", "rule", "version", "starts", "ends"])

    scanned = map_pandas(texts, read, LEDGER)
    # Repeated rows of one path were read more than once.
    once = scanned.groupBy("blob", "rule", "version").agg(
        F.any_value("starts").alias("starts"), F.any_value("ends").alias("ends")
    )
    return stored(once, "ledger")


def blob_spans(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``blob, spans`` of the blobs with findings: structs sorted by start, then by rule."""
    known = F.array(*[F.struct(F.lit(r.kind), F.lit(r.version), F.lit(i)) for i, r in enumerate(rules)])
    here = F.filter(known, lambda k: (k["col1"] == F.col("rule")) & (k["col2"] == F.col("version")))
    pairs = F.transform(
        F.arrays_zip("starts", "ends"),
        lambda z: F.struct(
            z["starts"].alias("start"),
            F.get(here, 0)["col3"].alias("place"),
            z["ends"].alias("end"),
            F.col("rule").alias("kind"),
        ),
    )
    found = ledger.where((F.size("starts") > 0) & (F.size(here) > 0))
    return found.groupBy("blob").agg(
        F.sort_array(F.flatten(F.collect_list(pairs))).alias("spans")
    )


def with_findings(
    docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Every row of ``docs`` as ``row``, with the ``spans`` of its blob."""
    paths = docs.select(F.struct(*every(docs)).alias("row"), address(F.col("text")).alias("blob"))
    found = blob_spans(ledger, rules)
    return paths.join(found, "blob", "left").withColumn(
        "spans", F.coalesce("spans", F.expr("array()").cast(found.schema["spans"].dataType))
    )


def redacted(docs: DataFrame, ledger: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans give one mark.

    ``n_chars`` is counted anew if there is such a column.
    """
    rows = with_findings(docs, ledger)
    text = F.col("row.text")
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.when(fresh, F.concat(state["done"], gap, F.lit(mark))).otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    def finish(state: Column) -> Column:
        return F.concat(state["done"], F.substring(text, state["at"] + 1, F.length(text)))

    clean = F.when(F.size("spans") == 0, text).otherwise(
        F.aggregate("spans", empty, step, finish)
    )
    out = rows.select("row", clean.alias("clean"))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.col("clean")
        elif c == "n_chars":
            value = F.length(F.col("clean")).cast(docs.schema[c].dataType)
            value = F.when(F.col("row.text").isNull(), F.col("row").getField(c)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: findings counted by base kind, and all spans as text."""
    narrow = docs.select("doc_id", "text")
    ledger = scan(narrow)
    found = (
        narrow.select("doc_id", address(F.col("text")).alias("blob"))
        .join(blob_spans(ledger), "blob", "left")
        .withColumn("spans", F.coalesce("spans", F.expr("array()").cast(blob_spans(ledger).schema["spans"].dataType)))
    )

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
