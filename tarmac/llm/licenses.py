"""Licence scans by sentence rules.

A text is cut into lines of whole clauses, each is normalised, and known sentences are replaced
by their identifiers, looked up in a hash map. A licence rule is an ordered sequence of
identifiers. It matches where the known sentences of a document hold that sequence without
another known sentence in between, whatever unknown text separates them. An item ``!id`` at a
rule's end forbids ``id`` as the next known sentence, so two-clause BSD is not found inside the
three-clause text, and reserved rights before a grant are not a licence of their own.

Clauses end at one of ``. ; : ! ?`` before white space (but for ``v.`` before a number) and at lines without a letter or digit.
Within a clause a line end is only a space if the next line begins with a lower-case letter or
the line ends in a word that demands another (``not``, ``the``, ``under`` and the like). At any
other line end a sentence may begin or end, so titles and wrapped capitals are both found; a
known sentence is a run of whole lines of one clause. A notice may be led in by its subject
("this file is released under the"); a negated one is not a known sentence.

Defined cases: null and empty texts have no sentences. Known sentences do not overlap: the first
wins, of those that start together the longest. Comment marks made of letters, such as ``rem``,
are text. Rules may overlap; each licence is listed once, in the order of the rules. Versions
"only" and "or later" count as the same licence; an exception after ``WITH`` is not looked at.
Very long texts are worked on in their task, one at a time. Repeated rows and null ids keep their
rows, an empty table gives an empty table, and clashing columns are replaced, whatever their case.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tarmac.llm.common import map_arrow, quoted

# Well-known licence sentences in normalised form, by identifier.
SENTENCES: dict[str, str] = {
    "apache-title": "apache license version 2 0 january 2004",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of "
    "this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included "
    "in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or "
    "implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose "
    "with or without fee is hereby granted provided that the above copyright notice and this "
    "permission notice appear in all copies",
    "isc-grant-old": "permission to use copy modify and distribute this software for any purpose "
    "with or without fee is hereby granted provided that the above copyright notice and this "
    "permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose "
    "with or without fee is hereby granted",
    "bsd-grant": "redistribution and use in source and binary forms with or without "
    "modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this "
    "list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution",
    "bsd-advert": "all advertising materials mentioning features or use of this software must "
    "display the following acknowledgement",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors "
    "may be used to endorse or promote products derived from this software without specific "
    "prior written permission",
    "bsd-endorse-author": "the name of the author may not be used to endorse or promote products "
    "derived from this software without specific prior written permission",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 2 of the "
    "license or at your option any later version",
    "gpl2-only": "you can redistribute it and or modify it under the terms of the gnu general "
    "public license version 2 as published by the free software foundation",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the "
    "license or at your option any later version",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "lgpl21-terms": "you can redistribute it and or modify it under the terms of the gnu lesser "
    "general public license as published by the free software foundation either version 2 1 of "
    "the license or at your option any later version",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-terms": "you can redistribute it and or modify it under the terms of the gnu lesser "
    "general public license as published by the free software foundation either version 3 of "
    "the license or at your option any later version",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero "
    "general public license as published by the free software foundation either version 3 of "
    "the license or at your option any later version",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-title": "mozilla public license version 2 0",
    "epl-terms": "this program and the accompanying materials are made available under the terms "
    "of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "cc0-title": "cc0 1 0 universal",
    "reserved": "all rights reserved",
}
# Names that a notice may give after "under the", by licence.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"
    ),
    "MIT": ("mit license", "mit licence"),
    "ISC": ("isc license",),
    "0BSD": ("0bsd license",),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "GPL-2.0": (
        "gnu general public license version 2", "gnu general public license v2", "gnu gpl v2",
        "gplv2", "gpl v2",
    ),
    "GPL-3.0": (
        "gnu general public license version 3", "gnu general public license v3", "gnu gpl v3",
        "gplv3", "gpl v3",
    ),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgplv2 1", "lgpl v2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgplv3", "lgpl v3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agplv3", "agpl v3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0"),
    "BSL-1.0": ("boost software license version 1 0",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("creative commons zero v1 0 universal license", "cc0 1 0", "cc0"),
    "CC-BY-NC-4.0": (
        "cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"
    ),
    "CC-BY-SA-4.0": (
        "cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"
    ),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
}
# Ordered rules by licence, beside its notices and short identifiers.
LICENCES: dict[str, tuple[tuple[str, ...], ...]] = {
    "Apache-2.0": (("apache-title",),),
    "MIT": (("mit-title",), ("mit-grant", "mit-condition", "mit-warranty")),
    "ISC": (("isc-title",), ("isc-grant",), ("isc-grant-old",)),
    "0BSD": (("0bsd-grant",),),
    "BSD-2-Clause": (
        ("bsd-grant", "bsd-source", "bsd-binary", "!bsd-endorse", "!bsd-endorse-author",
         "!bsd-advert"),
    ),
    "BSD-3-Clause": (
        ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"),
        ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-author"),
    ),
    "BSD-4-Clause": (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"),),
    "GPL-2.0": (("gpl2-terms",), ("gpl2-only",), ("gpl2-title",)),
    "GPL-3.0": (("gpl3-terms",), ("gpl3-title",)),
    "LGPL-2.1": (("lgpl21-terms",), ("lgpl21-title",)),
    "LGPL-3.0": (("lgpl3-terms",), ("lgpl3-title",)),
    "AGPL-3.0": (("agpl3-terms",), ("agpl3-title",)),
    "MPL-2.0": (("mpl-form",), ("mpl-title",)),
    "EPL-2.0": (("epl-terms",),),
    "BSL-1.0": (("boost-title",),),
    "Unlicense": (("unlicense-free",),),
    "CC0-1.0": (("cc0-title",),),
    "CC-BY-NC-4.0": (),
    "CC-BY-SA-4.0": (),
    "CC-BY-4.0": (),
    "All-Rights-Reserved": (
        ("reserved", "!bsd-grant", "!mit-grant", "!isc-grant", "!isc-grant-old", "!0bsd-grant"),
    ),
}
# A sentence of its own that names the licence.
TITLES = {
    "mit-title": ("mit license", "the mit license mit"),
    "isc-title": ("isc license",),
}
# Words after which a line end cannot end a sentence.
DEMANDING = (
    "a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "never", "no", "nor", "not",
    "of", "on", "or", "than", "the", "to", "under", "version", "with", "without",
)
_THING = "(?:file|software|code|source code|work|program|project|library|package|module|document)"
# Forms of a sentence that stand for one known sentence, applied in order.
REDUCED: tuple[tuple[str, str], ...] = (
    (
        rf"^(?:(?:this|the) {_THING} (?:is|are|was|has been) |it is |is )?"
        "(?:also |hereby |made |dual )?"
        "(?:licensed|released|distributed|available|provided|published|covered) (?:under|by) "
        "(?:the terms (?:and conditions )?of )?(?:the |a |an )?",
        "under ",
    ),
    (
        "^(under .+?)(?: the license| only| or later| or any later version"
        "| see (?:the )?(?:accompanying )?(?:file )?(?:license|copying|http).*)$",
        r"\1",
    ),
    (
        "^neither the names? of .{1,150} nor the names of .{1,60} may be used to endorse",
        "neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse",
    ),
    ("^copyright .{1,150} all rights reserved$", "all rights reserved"),
    ("^(spdx license identifier .+?)(?: only| or later)?(?: with .+)?$", r"\1"),
)
# First words of sentences that the forms above may shorten.
LEADING = (
    "this", "the", "it", "is", "also", "hereby", "made", "dual", "licensed", "released",
    "distributed", "available", "provided", "published", "covered", "neither", "copyright", "spdx",
)
# End of fixed values.

# A form may be so many characters longer than the sentence that it stands for.
LONGER = 300


def known_sentences() -> dict[str, str]:
    """Identifiers by normalised sentence, with notices and short identifiers of all licences."""
    known = {s: name for name, s in SENTENCES.items()}
    known |= {s: name for name, titles in TITLES.items() for s in titles}
    for licence, names in NAMES.items():
        known |= {f"under {n}": f"notice-{licence}" for n in names}
    for licence in LICENCES:
        short = re.sub("[^a-z0-9]+", " ", licence.lower())
        known[f"spdx license identifier {short}"] = f"spdx-{licence}"
    return known


def licence_rules() -> dict[str, list[tuple[str, ...]]]:
    """All rules by licence, in order."""
    return {
        licence: [(f"notice-{licence}",), (f"spdx-{licence}",), *rules]
        for licence, rules in LICENCES.items()
    }


_SPDX_LINE = re.compile(r"[^\n]*SPDX-License-Identifier:[^\n]*")
_SPDX = re.compile(r"SPDX-License-Identifier:|[ \t](?:OR|AND)[ \t]")
_VERSION = re.compile(r"([Vv])\.[ \t\r\n]+([0-9])")
_SIGN_CUT = re.compile(r"[.;:!?][ \t]+|[.;:!?][ \t\r\"')*/]*\n")
_BLANK = re.compile(r"\n(?:[^\w\n]|_)*\n")
_WRAPPED = re.compile(r"([^\n])\n(?:[^\w\n]|_)*([a-z])")
_UPPER = re.compile("[A-Z]+")
_SIGNS = re.compile(r"(?:[^\w\n]|_)+")
_OPEN = re.compile(rf"(^|[ \n])({'|'.join(DEMANDING)}) ?\n ?([^ \n])")
_REDUCED = tuple((re.compile(p), to) for p, to in REDUCED)


def _identifiers(line: re.Match) -> str:
    """A line of short identifiers as one clause for each licence of its expression."""
    return _SPDX.sub("\n\nSPDX-License-Identifier ", line[0]) + "\n"


def pieces(text: str | None) -> list[str]:
    """Normalised lines of a text; empty strings end clauses."""
    text = text or ""
    if "SPDX-License-Identifier:" in text:
        text = _SPDX_LINE.sub(_identifiers, text)
    text = _BLANK.sub("\n\n", _SIGN_CUT.sub("\n\n", _VERSION.sub(r"\1 \2", text)))
    text = _WRAPPED.sub(r"\1 \2", text)
    text = text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text)
    text = _OPEN.sub(r"\1\2 \3", _SIGNS.sub(" ", text))
    return [line.strip(" ") for line in text.split("\n")]


class Recogniser:
    """Known sentences of texts, found in a hash map from normalised sentences to identifiers."""

    def __init__(self, known: Mapping[str, str]):
        self.known = dict(known)
        self.longest = max(map(len, self.known), default=0) + LONGER
        self.first = {s.split(" ", 1)[0] for s in self.known} | set(LEADING)

    def identifier(self, sentence: str) -> str | None:
        found = self.known.get(sentence)
        if found is None:
            for pattern, to in _REDUCED:
                sentence = pattern.sub(to, sentence)
            found = self.known.get(sentence)
        return found

    def _at(self, lines: list[str], start: int) -> tuple[str | None, int]:
        """The longest known run of lines from ``start``, and the line after it."""
        best, sentence = (None, start + 1), ""
        for end in range(start, len(lines)):
            if not lines[end] or len(sentence) + len(lines[end]) > self.longest:
                break
            sentence = f"{sentence} {lines[end]}" if sentence else lines[end]
            found = self.identifier(sentence)
            if found is not None:
                best = found, end + 1
        return best

    def __call__(self, text: str | None) -> tuple[int, list[str]]:
        """The number of lines and the identifiers of the known sentences, in order."""
        lines, found, at = pieces(text), [], 0
        while at < len(lines):
            name = None
            if lines[at].split(" ", 1)[0] in self.first:
                name, at = self._at(lines, at)
            else:
                at += 1
            if name is not None:
                found.append(name)
        return sum(map(bool, lines)), found


def _marked(ids: Sequence[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _times(line: Column, ids: Sequence[str]) -> Column:
    """How often a sequence of identifiers occurs in ``line``."""
    sought = _marked(ids)
    left = F.length(F.replace(line, F.lit(sought), F.lit("")))
    return (F.length(line) - left) / len(sought)


def _matches(line: Column, rule: Sequence[str]) -> Column:
    wanted = [i for i in rule if not i.startswith("!")]
    barred = [i[1:] for i in rule if i.startswith("!")]
    if not barred:
        return line.contains(_marked(wanted))
    return _times(line, wanted) > sum((_times(line, [*wanted, i]) for i in barred), F.lit(0))


def with_licences(
    docs: DataFrame,
    known: Mapping[str, str] | None = None,
    licences: Mapping[str, Sequence[Sequence[str]]] | None = None,
) -> DataFrame:
    """``docs`` with ``n_sentences``, ``sentence_ids`` and ``licences`` (arrays).

    They replace columns of those names. ``known`` gives identifiers by normalised sentence,
    ``licences`` the rules over them; identifiers hold no ``<`` or ``>``.
    """
    known = known_sentences() if known is None else known
    licences = licence_rules() if licences is None else licences
    new = [StructField("n_sentences", LongType()), StructField("sentence_ids", ArrayType(StringType()))]
    taken = {"n_sentences", "sentence_ids", "licences"}
    kept = [f for f in docs.schema if f.name.lower() not in taken]
    place = [f.name for f in kept].index("text")

    def run(batches):
        recognise = Recogniser(known)
        for batch in batches:
            found = [recognise(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([ids for _, ids in found], pa.list_(pa.string())),
                ],
                names=[*batch.schema.names, "n_sentences", "sentence_ids"],
            )

    columns = [F.col(quoted(f.name)) for f in kept]
    found = map_arrow(docs.select(*columns), run, StructType([*kept, *new]))
    line = F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    matches = [
        F.when(_any([_matches(line, rule) for rule in rules]), F.lit(name))
        for name, rules in licences.items()
    ]
    return found.withColumn("licences", F.array_compact(F.array(*matches)))


def _any(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def licence_digest(docs: DataFrame) -> DataFrame:
    """One row per document: sentences, the known ones in order, and the licences found."""
    return with_licences(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_sentences",
        F.size("sentence_ids").cast("bigint").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )
