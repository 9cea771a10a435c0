"""License scans by ordered signature rules, with built-in functions only.

A text becomes its words in one line. Rules are regular expressions over words, each gated by keywords
of which one must stand in the line before the expression is tried. Detections of all rules are word intervals;
one that lies inside the interval of a rule of higher rank is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.llm.quality_rules import let

#: Everything but digits, letters of either case and non-ASCII characters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK = "\x01"

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label, keyword that begins at a word's start, and name as an expression over words ("gpl 3 0" is "GPL-3.0").
_V = "(?: version| v)?"
NAMES = [
    ("mit", "mit", "(?:mit|expat)"),
    ("mit-0", "mit 0", "mit (?:0|no attribution)"),
    ("apache-2", "apache", f"apache(?: software)?(?: license)?{_V} v?2(?: 0)?"),
    ("apache-1.1", "apache", f"apache(?: software)?(?: license)?{_V} 1 1"),
    ("gpl-1", "gpl", f"(?:gnu )?(?:gpl|general public license){_V} v?1(?: 0)?"),
    ("gpl-2", "gpl", f"(?:gnu )?(?:gpl|general public license){_V} v?2(?: 0)?"),
    ("gpl-3", "gpl", f"(?:gnu )?(?:gpl|general public license){_V} v?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", f"(?:gnu )?(?:lgpl|lesser general public license){_V} v?2 1"),
    ("lgpl-3", "lgpl", f"(?:gnu )?(?:lgpl|lesser general public license){_V} v?3(?: 0)?"),
    ("agpl-3", "agpl", f"(?:gnu )?(?:agpl|affero general public license){_V} v?3(?: 0)?"),
    ("mpl-1.1", "mpl", f"(?:mozilla public license|mpl){_V} 1 1"),
    ("mpl-2", "mpl", f"(?:mozilla public license|mpl){_V} v?2(?: 0)?"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    ("bsd-4", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost-1", "bsl", f"(?:boost software license|bsl){_V} 1(?: 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc-by", "cc by", "(?:cc by|creative commons attribution)"),
    ("cc-by-sa", "cc by sa", "(?:cc by sa|creative commons attribution sharealike)"),
    ("cc-by-nd", "cc by nd", "(?:cc by nd|creative commons attribution noderiv(?:ative)?s)"),
    ("cc-by-nc", "cc by nc", "(?:cc by nc|creative commons attribution noncommercial)"),
    ("cc-by-nc-sa", "cc by nc sa", "(?:cc by nc sa|creative commons attribution noncommercial sharealike)"),
    ("cc-by-nc-nd", "cc by nc nd", "(?:cc by nc nd|creative commons attribution noncommercial noderiv(?:ative)?s)"),
    ("epl-1", "epl", f"(?:eclipse public license|epl){_V} v?1(?: 0)?"),
    ("epl-2", "epl", f"(?:eclipse public license|epl){_V} v?2(?: 0)?"),
    ("cddl-1", "cddl", f"(?:common development and distribution license|cddl){_V} 1(?: 0)?"),
    ("cpl-1", "common public license", f"common public license{_V} 1(?: 0)?"),
    ("artistic-1", "artistic", f"artistic(?: license)?{_V} 1(?: 0)?"),
    ("artistic-2", "artistic", f"artistic(?: license)?{_V} 2(?: 0)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2", "psf", f"(?:python software foundation|psf){_V}(?: license)? 2(?: 0)?"),
    ("ofl-1.1", "ofl", f"(?:sil open font license|ofl){_V} 1 1"),
    ("eupl-1.2", "eupl", f"(?:european union public licen[cs]e|eupl){_V} 1 2"),
    ("ms-pl", "ms pl", "(?:microsoft public license|ms pl)"),
    ("ms-rl", "ms rl", "(?:microsoft reciprocal license|ms rl)"),
    ("odbl-1", "odbl", f"(?:open database license|odbl){_V}(?: 1 0)?"),
    ("pddl-1", "pddl", f"(?:public domain dedication and license|pddl){_V}(?: 1 0)?"),
    ("gfdl-1.3", "gfdl", f"(?:gnu )?(?:gfdl|free documentation license){_V} 1 3"),
    ("elastic-2", "elastic license", f"elastic license{_V} 2(?: 0)?"),
    ("sspl-1", "sspl", f"(?:server side public license|sspl){_V} 1"),
    ("busl-1.1", "busl", f"(?:business source license|busl){_V} 1 1"),
]
#: Second keyword of names with an alternative that does not hold the first one.
ALSO = {
    "mit": "expat",
    "mit-0": "mit no attribution",
    "gpl-1": "general public license",
    "gpl-2": "general public license",
    "gpl-3": "general public license",
    "lgpl-2.1": "lesser general public license",
    "lgpl-3": "lesser general public license",
    "agpl-3": "affero general public license",
    "mpl-1.1": "mozilla public license",
    "mpl-2": "mozilla public license",
    "bsd-2": "freebsd",
    "0bsd": "0bsd",
    "boost-1": "boost software license",
    "cc-by": "creative commons attribution",
    "cc-by-sa": "creative commons attribution sharealike",
    "cc-by-nd": "creative commons attribution noderiv",
    "cc-by-nc": "creative commons attribution noncommercial",
    "cc-by-nc-sa": "creative commons attribution noncommercial sharealike",
    "cc-by-nc-nd": "creative commons attribution noncommercial noderiv",
    "epl-1": "eclipse public license",
    "epl-2": "eclipse public license",
    "cddl-1": "common development and distribution license",
    "python-2": "python software foundation",
    "ofl-1.1": "sil open font license",
    "eupl-1.2": "european union public licen",
    "ms-pl": "microsoft public license",
    "ms-rl": "microsoft reciprocal license",
    "odbl-1": "open database license",
    "pddl-1": "public domain dedication and license",
    "gfdl-1.3": "free documentation license",
    "sspl-1": "server side public license",
    "busl-1.1": "business source license",
}
#: What may stand around a name: rank (lower goes first), confidence, words before, words after.
SHAPES = [
    (1, 1.0, "(?:licensed|released|distributed|published|available|provided|covered)(?: [^ ]+){0,3} (?:under|by) (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?", "(?: licen[cs]e)?"),
    (1, 1.0, "spdx license identifier ", "(?: only| or later)?"),
    (2, 0.9, "(?:under|by) (?:the )?(?:terms of )?(?:the )?", " licen[cs]e"),
    (3, 0.8, "", "(?: international| unported| generic)? licen[cs]e"),
    (3, 0.7, "licen[cs]e(?: is| type| name)? ", ""),
    (3, 0.7, "(?:see|copy of|text of) the ", "(?: licen[cs]e)?"),
]
#: Notices that need no name: label, keyword, rank, confidence, expression.
NOTICES = [
    ("public-domain", "public domain", 2, 0.9, "(?:in|into|to) the public domain"),
    ("proprietary", "rights reserved", 4, 0.5, "all rights reserved"),
    ("proprietary", "proprietary", 3, 0.7, "(?:proprietary and confidential|confidential and proprietary)"),
    ("mit", "permission is hereby granted", 1, 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd-family", "redistribution and use", 1, 0.9, "redistribution and use in source and binary forms"),
    ("isc", "permission to use", 1, 0.9, "permission to use copy modify and(?: or)? distribute this software"),
    ("gpl-family", "free software foundation", 2, 0.8, "as published by the free software foundation"),
    ("gpl-family", "gnu", 4, 0.6, "gnu (?:lesser |affero )?general public licen[cs]e"),
    ("unlicense", "unencumbered", 1, 1.0, "free and unencumbered software released into the public domain"),
    ("cc-family", "creative commons", 4, 0.5, "creative commons(?: licen[cs]e)?"),
    ("apache-2", "you may not use this file", 1, 0.9, "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2", "unless required by applicable law", 2, 0.8, "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("mpl-2", "this source code form", 1, 1.0, "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("gpl-family", "this program is free software", 1, 0.9, "this program is free software you can redistribute it and or modify it"),
    ("lgpl-family", "this library is free software", 1, 0.9, "this library is free software you can redistribute it and or modify it"),
    ("gpl-family", "without even the implied warranty", 3, 0.6, "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-family", "redistributions of source code", 1, 0.9, "redistributions of source code must retain the above copyright notice"),
    ("bsd-family", "redistributions in binary form", 1, 0.9, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "neither the name of", 1, 0.9, "neither the name of (?:the )?(?:[^ ]+ ){1,6}nor the names of its contributors"),
    ("bsd-4", "all advertising materials", 1, 0.9, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("mit", "the above copyright notice", 1, 0.9, "the above copyright notice and this permission notice shall be included in all copies"),
    ("boost-1", "permission is hereby granted", 1, 1.0, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib", "altered source versions", 1, 0.9, "altered source versions must be plainly marked as such"),
    ("zlib", "this software is provided as is", 2, 0.8, "this software is provided as is without any express or implied warranty"),
    ("cc0", "to the extent possible under law", 1, 0.9, "to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related"),
    ("epl-family", "this program and the accompanying", 1, 0.9, "this program and the accompanying materials are made available under the terms"),
    ("unlicense", "anyone is free to copy", 1, 0.9, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("ofl-family", "this font software", 1, 1.0, "this font software is licensed under the sil open font license"),
    ("cc-family", "you must give appropriate credit", 3, 0.6, "you must give appropriate credit provide a link to the licen[cs]e"),
]


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    keyword: str
    rank: int
    confidence: float
    body: str
    base: bool
    also: str | None = None


def signature_rules() -> list[Rule]:
    """All rules in order: base phrases, then every name in every shape, then the notices."""
    rows = [(label, phrase, 0, 1.0, phrase, True) for phrase, label in BASE_PHRASES.items()]
    for label, keyword, name in NAMES:
        rows += [(label, keyword, rank, sure, before + name + after, False, ALSO.get(label)) for rank, sure, before, after in SHAPES]
    rows += [(label, keyword, rank, sure, body, False) for label, keyword, rank, sure, body in NOTICES]
    return [Rule(n, *row) for n, row in enumerate(rows)]


#: A text without any of these has no detection: each rule's expression holds one of them.
GATE = ("licen", "by nc", "spdx", "released", "distributed", "published", "available", "provided", "covered", "the public domain",
        "rights reserved", "proprietary", "permission", "redistribution", "creative commons", "see the", "copy of the", "text of the",
        "can redistribute it", "implied warranty", "contributors", "advertising materials", "altered source", "waived all copyright", "free to copy")


def _rules_column(rules: list[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.number).alias("number"),
                F.lit(r.label).alias("label"),
                F.lit(" " + r.keyword).alias("keyword"),
                F.lit(None if r.also is None else " " + r.also).cast("string").alias("also"),
                F.lit(r.rank).alias("rank"),
                F.lit(r.confidence).alias("confidence"),
                F.lit(f"(?<= )({r.body})(?= )").alias("pattern"),
                F.lit(r.base).alias("base"),
            )
            for r in rules
        ]
    )


def _places(line: Column, rule: Column) -> Column:
    """All matches of a rule: the first word of each is marked, and its place among the words is read off."""
    marked = F.split(F.trim(F.regexp_replace(line, rule["pattern"], F.lit(_MARK + "$1"))), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(_MARK), i)), lambda i: i.isNotNull())
    found = F.regexp_extract_all(line, rule["pattern"], F.lit(1))
    return F.zip_with(
        starts,
        found,
        lambda start, words: F.struct(
            start.cast("long").alias("first"),
            (start + F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long").alias("end"),
            rule["number"].alias("number"),
            rule["label"].alias("label"),
            rule["rank"].alias("rank"),
            rule["confidence"].alias("confidence"),
            rule["base"].alias("base"),
        ),
    )


def _kept(found: Column) -> Column:
    """Detections not suppressed. Inside an equal interval the lower rank, then the earlier rule, stays."""

    def inside(x: Column, y: Column) -> Column:
        within = (y["first"] <= x["first"]) & (x["end"] <= y["end"])
        longer = (y["end"] - y["first"]) > (x["end"] - x["first"])
        before = (y["rank"] < x["rank"]) | ((y["rank"] == x["rank"]) & (longer | (~longer & (y["number"] < x["number"]))))
        return within & before

    others = F.filter(found, lambda x: ~x["base"])
    return let(others, lambda d: F.filter(d, lambda x: ~F.exists(d, lambda y: inside(x, y))))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections for every row.

    detections are the kept intervals (first word, end, label, confidence), base phrases included. score is
    the largest confidence among them, 0 without any. Null and empty texts have no words and no detections;
    label lists are then empty strings. Null ids stay, repeated rows are scanned one by one, an empty table
    gives an empty result, extra columns are dropped. The time for one text is linear in its words, and
    quadratic in its detections.
    """
    rules = signature_rules()
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = F.trim(F.regexp_replace(text, SEPARATORS, " "))
    rows = docs.select("doc_id", packed.alias("_packed"))

    def gate(line: Column) -> Column:
        out = F.lit(False)
        for phrase in GATE:
            out = out | line.contains(phrase)
        return out

    none = F.lit(None)
    kind = "array<struct<first:bigint,end:bigint,number:int,label:string,rank:int,confidence:double,base:boolean>>"

    def detect(line: Column) -> Column:
        opened = lambda r: F.contains(line, r["keyword"]) | F.coalesce(F.contains(line, r["also"]), F.lit(False))
        tried = F.filter(_rules_column(rules), lambda r: opened(r) & F.rlike(line, r["pattern"]))
        return F.flatten(F.transform(tried, lambda r: _places(line, r)))

    # lower() folds more than A-Z and so lets more through the gate; the rules see A-Z folded only
    line = F.concat(F.lit(" "), F.translate("_packed", UPPER, LOWER), F.lit(" "))
    found = F.when(let(F.lower("_packed"), gate), let(line, detect)).otherwise(F.array().cast(kind))

    def result(d: Column) -> Column:
        base = F.filter(d, lambda x: x["base"])
        labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
        kept = F.concat(base, _kept(d))
        return let(
            F.struct(base.alias("base"), kept.alias("kept")),
            lambda s: F.struct(
                F.size(s["base"]).cast("long").alias("n_base"),
                F.array_min(F.transform(s["base"], lambda x: x["first"])).alias("first_word"),
                F.array_max(F.transform(s["base"], lambda x: x["first"])).alias("last_word"),
                labels(s["base"]).alias("base_labels"),
                labels(s["kept"]).alias("labels"),
                F.coalesce(F.array_max(F.transform(s["kept"], lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
                F.array_sort(
                    F.transform(s["kept"], lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end"), x["label"].alias("label"), x["confidence"].alias("confidence")))
                ).alias("detections"),
            ),
        )

    n_words = F.when(F.col("_packed") == "", F.lit(0)).otherwise(
        F.length("_packed") - F.length(F.replace("_packed", F.lit(" "), F.lit(""))) + 1
    )
    scanned = rows.select("doc_id", n_words.cast("long").alias("n_words"), let(found, result).alias("_r"))
    return scanned.select("doc_id", "n_words", "_r.n_base", "_r.first_word", "_r.last_word", "_r.base_labels", "_r.labels", "_r.score", "_r.detections")


def scan_sql(table: str = "documents") -> str:
    """The same scan in SQL for an engine without look-around: every word gets blanks of its own."""
    rules = signature_rules()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(
        f"({r.number}, {quote(r.label)}, {quote(r.keyword)}, {quote(r.also or r.keyword)}, {r.rank}, {r.confidence}, {quote(' (?:' + r.body.replace(' ', '  ').replace('[^  ]', '[^ ]') + ') ')}, {str(r.base).lower()})"
        for r in rules
    )
    return rf"""
WITH rules(number, label, keyword, also, rank, confidence, pattern, base) AS (VALUES {values}),
lines AS (
  SELECT row_number() OVER () AS id, doc_id,
    trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS packed
  FROM {table}),
spread AS (
  SELECT id, doc_id, packed, CASE WHEN packed = '' THEN 0 ELSE length(packed) - length(replace(packed, ' ', '')) + 1 END AS n_words,
    '  ' || replace(packed, ' ', '  ') || '  ' AS line FROM lines),
hits AS (
  SELECT s.id, r.*, string_split_regex(s.line, r.pattern) AS gaps, regexp_extract_all(s.line, r.pattern) AS found
  FROM spread s JOIN rules r ON (contains(s.packed, r.keyword) OR contains(s.packed, r.also)) AND regexp_matches(s.line, r.pattern)),
counted AS (
  SELECT *, list_transform(gaps, lambda x: len(regexp_extract_all(x, '[^ ]+'))) AS gap_n, list_transform(found, lambda x: len(regexp_extract_all(x, '[^ ]+'))) AS found_n
  FROM hits),
places AS (
  SELECT c.*, k, CAST(list_sum(gap_n[1:k]) + coalesce(list_sum(found_n[1:k - 1]), 0) AS BIGINT) AS first, found_n[k] AS n
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM counted) c),
kept AS (
  SELECT * FROM places x WHERE base OR NOT EXISTS (
    SELECT 1 FROM places y WHERE y.id = x.id AND NOT y.base AND y.first <= x.first AND x.first + x.n <= y.first + y.n
      AND (y.rank < x.rank OR (y.rank = x.rank AND (y.n > x.n OR (y.n <= x.n AND y.number < x.number)))))),
summed AS (
  SELECT id, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(confidence) AS score FROM kept GROUP BY id)
SELECT s.doc_id, CAST(s.n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM spread s LEFT JOIN summed t ON s.id = t.id"""
