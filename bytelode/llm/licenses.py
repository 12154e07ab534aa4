"""Operator 1: licence scan by ordered signature rules, in DataFrame functions alone.

A text becomes its words (A-Z lower-cased, joined by single blanks). A cheap search for
a few keywords gates the scan; each rule is gated again by a keyword of its own. A rule
is a regular expression over whole words with a label, a priority and a score. Of
detections whose word intervals contain each other, one is suppressed if an interval
around it has a stronger priority, or the same priority and comes first (earlier start,
then later end). The scan needs no shuffle: all of it happens within the row.

Defined results: null text is empty text (no words, no labels, score 0). Repeated rows
are scanned each. Other columns are ignored. No text is cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import let, lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MARK = "\x01"

_L = "licen[sc]e"
_V = "(?:v|version )?"
#: label, keyword, what the licence is called in full, what it is called after "licensed under" and the like.
LICENCES = [
    ("mit", "mit", f"mit {_L}", "(?:x11 )?mit"),
    ("mit-0", "mit", f"mit no attribution(?: {_L})?", "mit 0"),
    ("expat", "expat", f"expat {_L}", "expat"),
    ("x11", "x11", f"x11 {_L}", "x11"),
    ("apache-1.1", "apache", f"apache (?:software )?{_L} {_V}1 1", f"apache {_V}1 1"),
    ("apache-2.0", "apache", f"apache (?:software )?{_L} {_V}2(?: 0)?", f"apache {_V}2(?: 0)?"),
    ("gpl-1.0", "general public", f"(?:gnu )?general public {_L} {_V}1(?: 0)?", "gpl ?v?1(?: 0)?"),
    ("gpl-2.0", "general public", f"(?:gnu )?general public {_L} {_V}2(?: 0)?", "gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "general public", f"(?:gnu )?general public {_L} {_V}3(?: 0)?", "gpl ?v?3(?: 0)?"),
    ("lgpl-2.0", "general public", f"(?:gnu )?(?:library|lesser) general public {_L} {_V}2(?: 0)?", "lgpl ?v?2 0"),
    ("lgpl-2.1", "general public", f"(?:gnu )?lesser general public {_L} {_V}2 1", "lgpl ?v?2 1"),
    ("lgpl-3.0", "general public", f"(?:gnu )?lesser general public {_L} {_V}3(?: 0)?", "lgpl ?v?3(?: 0)?"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public {_L}(?: {_V}3(?: 0)?)?", "agpl ?v?3(?: 0)?"),
    ("gfdl-1.3", "free documentation", f"(?:gnu )?free documentation {_L}(?: {_V}1 3)?", "gfdl(?: 1 3)?"),
    ("mpl-1.1", "mozilla", f"mozilla public {_L} {_V}1 1", "mpl ?v?1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public {_L} {_V}2(?: 0)?", "mpl ?v?2(?: 0)?"),
    ("epl-1.0", "eclipse", f"eclipse public {_L} {_V}1(?: 0)?", "epl ?v?1(?: 0)?"),
    ("epl-2.0", "eclipse", f"eclipse public {_L} {_V}2(?: 0)?", "epl ?v?2(?: 0)?"),
    ("edl-1.0", "eclipse", f"eclipse distribution {_L}(?: {_V}1(?: 0)?)?", "edl 1(?: 0)?"),
    ("cddl-1.0", "common development", f"common development and distribution {_L}(?: {_V}1(?: 0)?)?", "cddl(?: 1 0)?"),
    ("cpl-1.0", "common public", f"common public {_L}(?: {_V}1(?: 0)?)?", "cpl 1 0"),
    ("eupl-1.2", "european", f"european union public {_L}(?: {_V}1 2)?", "eupl(?: 1 2)?"),
    ("bsd-2-clause", "bsd", f"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: {_L})?", "(?:2 clause bsd|bsd 2 clause)"),
    ("bsd-3-clause", "bsd", f"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: {_L})?", "(?:3 clause bsd|bsd 3 clause)"),
    ("bsd-4-clause", "bsd", f"(?:original bsd|bsd 4 clause|4 clause bsd)(?: {_L})?", "(?:4 clause bsd|bsd 4 clause)"),
    ("0bsd", "bsd", f"(?:zero clause bsd|bsd zero clause)(?: {_L})?", "0bsd"),
    ("bsd", "bsd", f"bsd(?: style)? {_L}", "bsd"),
    ("isc", "isc", f"isc {_L}", "isc"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_L}", "zlib"),
    ("libpng", "libpng", f"libpng {_L}", "libpng"),
    ("bsl-1.0", "boost", f"boost software {_L}(?: {_V}1(?: 0)?)?", "bsl 1 0"),
    ("artistic-1.0", "artistic", f"artistic {_L} {_V}1(?: 0)?", "artistic 1(?: 0)?"),
    ("artistic-2.0", "artistic", f"artistic {_L} {_V}2(?: 0)?", "artistic 2(?: 0)?"),
    ("afl-3.0", "academic", f"academic free {_L}(?: {_V}3(?: 0)?)?", "afl 3 0"),
    ("osl-3.0", "open software", f"open software {_L}(?: {_V}3(?: 0)?)?", "osl 3 0"),
    ("ofl-1.1", "open font", f"(?:sil )?open font {_L}(?: {_V}1 1)?", "ofl(?: 1 1)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", f"wtfpl(?: {_L})?", "wtfpl"),
    ("cc0-1.0", "cc0", "cc0(?: 1(?: 0)?)?(?: universal)?", "cc0(?: 1 0)?"),
    ("cc-by-3.0", "cc by", "cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "cc by", "cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-3.0", "cc by sa", "cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa", "cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-3.0", "cc by nc", "cc by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc by nc", "cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc by nd", "cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", "cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", "cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by", "creative commons", f"creative commons attribution(?: [0-9]+ [0-9]+)?(?: international| unported)?(?: {_L})?", "creative commons by"),
    ("cc-by-sa", "creative commons", f"creative commons attribution share ?alike(?: [0-9]+ [0-9]+)?(?: international| unported)?(?: {_L})?", "creative commons by sa"),
    ("cc-by-nc", "creative commons", f"creative commons attribution non ?commercial(?: [0-9]+ [0-9]+)?(?: international| unported)?(?: {_L})?", "creative commons by nc"),
    ("cc-by-nd", "creative commons", f"creative commons attribution no ?deriv(?:ative)?s(?: [0-9]+ [0-9]+)?(?: international| unported)?(?: {_L})?", "creative commons by nd"),
    ("odbl-1.0", "database", f"open (?:data commons open )?database {_L}(?: {_V}1(?: 0)?)?", "odbl(?: 1 0)?"),
    ("pddl-1.0", "dedication", f"(?:open data commons )?public domain dedication(?: and {_L})?", "pddl(?: 1 0)?"),
    ("python-2.0", "python", f"python(?: software foundation)? {_L}(?: {_V}2(?: 0)?)?", "psf"),
    ("php-3.01", "php", f"php {_L}(?: {_V}3 01)?", "php 3 01"),
    ("ruby", "ruby", f"ruby {_L}", "ruby"),
    ("postgresql", "postgresql", f"postgresql {_L}", "postgresql"),
    ("openssl", "openssl", f"openssl {_L}", "openssl"),
    ("ms-pl", "microsoft", f"microsoft public {_L}", "ms pl"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {_L}", "ms rl"),
    ("openrail", "rail", f"(?:big ?science |creativeml )?(?:open )?rail(?: m)? {_L}", "(?:open ?)?rail(?: m)?"),
    ("busl-1.1", "business source", f"business source {_L}(?: {_V}1 1)?", "busl 1 1"),
    ("sspl-1.0", "server side", f"server side public {_L}(?: {_V}1(?: 0)?)?", "sspl(?: 1 0)?"),
    ("elastic-2.0", "elastic", f"elastic {_L}(?: {_V}2(?: 0)?)?", "elastic 2 0"),
]
#: Notices that name no licence by its title: label, keyword, words, priority, score.
NOTICES = [
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 2, 0.95),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 2, 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 2, 0.95),
    ("public-domain", "public domain", "(?:released|placed|dedicated|put) (?:in ?to|to|in) the public domain", 2, 0.9),
    ("public-domain", "public domain", "(?:is|are) in the public domain", 3, 0.7),
    ("proprietary", "all rights", "all rights reserved", 4, 0.4),
    ("proprietary", "proprietary", "proprietary and confidential", 3, 0.7),
    ("no-warranty", "warrant", "provided as is without warranty(?: of any kind)?", 4, 0.3),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 4, 0.3),
]
_GIVEN = "(?:licen[sc]ed|released|distributed|available|provided|published|covered|offered|redistributed|shared) under"
_UNDER = f"(?:dual )?{_GIVEN} (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, words, priority, score); priority 1 is the strongest."""
    out = list(NOTICES)
    for label, keyword, full, short in LICENCES:
        out.append((label, "spdx", f"spdx {_L} identifier {label.replace('-', ' ').replace('.', ' ')}", 1, 1.0))
        out.append((label, "under", f"{_UNDER}(?:{full}|{short})", 2, 0.95))
        out.append((label, "licen", f"{_L} (?:{full}|{short})", 2, 0.9))
        out.append((label, keyword, full, 3, 0.8))
    return out


def _needed(keyword: str, words: str) -> str:
    """What every match of a rule holds: "licen", words without choices, or the rule's keyword."""
    if keyword == "under":
        return _GIVEN
    rest, before = words, None
    while rest != before:
        before, rest = rest, re.sub(r"\(\?:[^()]*\)\?", "", rest)
    if "licen" in re.sub(r"\(\?:[^()]*\)", "", rest):
        return "licen"
    return rest if re.fullmatch("[a-z0-9 ]+", rest) else keyword


#: A text that holds none of these cannot hold any rule's words.
GATE = "(?i)" + "|".join(sorted({_needed(k, w).replace(" ", SEPARATORS) for _, k, w, _, _ in rules()} | {"licen"}))


def whole_words(words: str) -> str:
    return f"(?<![^ ])(?:{words})(?![^ ])"


def _places(norm: Column, pattern: Column) -> Column:
    """Word indexes at which the pattern's matches start; one pass over the marked text."""
    marked = F.split(F.regexp_replace(norm, pattern, F.lit(MARK + "$0")), " ")
    return F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i).otherwise(-1)), lambda i: i >= 0)


def _detections(norm: Column) -> Column:
    """All detections as structs (start, -end, priority, label, score), sorted."""
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip((k, whole_words(w), p, label, s), ("keyword", "words", "priority", "label", "score"))]) for label, k, w, p, s in rules()])
    gated = F.filter(table, lambda r: F.contains(norm, r["keyword"]) & F.rlike(norm, r["words"]))
    found = F.transform(
        gated,
        lambda r: F.zip_with(
            _places(norm, r["words"]),
            F.regexp_extract_all(norm, r["words"], F.lit(0)),
            lambda i, m: F.struct(
                i.cast("long").alias("start"),
                (-(i + F.size(F.split(m, " ")))).cast("long").alias("minus_end"),
                r["priority"].alias("priority"), r["label"].alias("label"), r["score"].alias("score"),
            ),
        ),
    )
    return F.array_sort(F.flatten(found))


def _kept(found: Column) -> Column:
    """Labels and the best score of detections that no stronger one contains; one fold, with state bounded by the labels."""
    none = F.lit(-1).cast("long")
    start = F.struct(none.alias("e1"), none.alias("e2"), none.alias("e3"), none.alias("e4"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(a: Column, d: Column) -> Column:
        end, p = -d["minus_end"], d["priority"]
        around = F.when(p == 1, a["e1"]).when(p == 2, a["e2"]).when(p == 3, a["e3"]).otherwise(a["e4"])
        keep = end > around
        reach = [F.when(p <= k, F.greatest(a[f"e{k}"], end)).otherwise(a[f"e{k}"]).alias(f"e{k}") for k in (1, 2, 3, 4)]
        return F.struct(*reach, F.when(keep, F.array_union(a["labels"], F.array(d["label"]))).otherwise(a["labels"]).alias("labels"), F.when(keep, F.greatest(a["score"], d["score"])).otherwise(a["score"]).alias("score"))

    return F.aggregate(found, start, step)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    norm = F.when(F.rlike("text", F.lit(GATE)), F.trim(F.regexp_replace(lower_ascii(F.col("text")), SEPARATORS, " ")))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), norm.alias("norm"))
    any_base = F.lit(whole_words("|".join(BASE)))
    gated = F.col("norm").isNotNull()
    rows = rows.select(
        "doc_id", "n_words",
        F.when(gated, let(F.col("norm"), lambda n: _kept(_detections(n)))).alias("kept"),
        F.when(gated, _places(F.col("norm"), any_base)).alias("base"),
        F.when(gated, F.array_distinct(F.regexp_extract_all("norm", any_base, F.lit(0)))).alias("phrases"),
    )
    names = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    base_labels = F.coalesce(F.transform("phrases", lambda p: names[p]), F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"),
        F.array_max("base").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("kept.labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("kept.score", F.lit(0.0)), F.when(F.size(base_labels) > 0, 0.8).otherwise(0.0)).alias("score"),
    )
