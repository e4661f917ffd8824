r"""Operator 7, license scans: ordered signature rules, on DataFrame functions only.

A text is taken as its words, lower-cased in A-Z and joined by single spaces. A coarse test of the whole text for
any keyword of the rules lets most texts pass at once. The rest is read in overlapping pieces of PIECE words, so that the work is linear in a text's length; in a
piece with a keyword, the rules whose own keyword occurs are matched, each match an interval of words. A match inside the interval of another is suppressed if the other's rule has the higher
priority, or the same priority and a longer match, or comes earlier in the order. The labels of what is left are the method's.

Base places of the four phrases are counted beside that and are never suppressed.

Defined results: a null or empty text has no words, no places (first_word and last_word null), empty labels and score 0; repeated
rows are each scanned; an empty table gives an empty table; extra columns are kept, whatever their names, but for those named as an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import unused

#: Fixed values of the contract: phrase, label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_VERSION = r"(?:(?:version|v|ver) )?"
_LATER = r"(?:at your option )?(?:any )?(?:later|newer|above)(?: version)?"
_LICENSE = r"(?:licen[sc]e|licensed|licensing)"
_CC_LONG = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ate)?s?(?: works)?"}
_CC_KINDS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: label stem, keyword, name pattern, versions. A version "3 0" also stands for "3".
_VERSIONED = (
    ("gpl", "general public", r"gnu general public", ("1 0", "2 0", "3 0")),
    ("lgpl", "general public", r"gnu (?:lesser|library) general public", ("2 0", "2 1", "3 0")),
    ("agpl", "general public", r"gnu affero general public", ("1 0", "3 0")),
    ("gfdl", "gnu free documentation", r"gnu free documentation", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache(?: software)?", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla public", r"mozilla public", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public", r"eclipse public", ("1 0", "2 0")),
    ("eupl", "european union", r"european union public", ("1 0", "1 1", "1 2")),
    ("cddl", "common development", r"common development and distribution", ("1 0", "1 1")),
    ("artistic", "artistic licen", r"artistic", ("1 0", "2 0")),
    ("afl", "academic free", r"academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "open software", r"open software", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("zpl", "zope public", r"zope public", ("1 1", "2 0", "2 1")),
    ("php", "php licen", r"php", ("3 0", "3 01")),
    ("lppl", "latex project", r"latex project public", ("1 0", "1 1", "1 2", "1 3")),
    ("ofl", "open font", r"(?:sil )?open font", ("1 0", "1 1")),
    ("odbl", "database licen", r"open (?:data commons open )?database", ("1 0",)),
    ("sspl", "server side", r"server side public", ("1 0",)),
    ("busl", "business source", r"business source", ("1 0", "1 1")),
    ("elastic", "elastic licen", r"elastic", ("1 0", "2 0")),
    ("upl", "universal permissive", r"universal permissive", ("1 0",)),
    ("cpl", "common public", r"common public", ("1 0",)),
    ("ipl", "ibm public", r"ibm public", ("1 0",)),
    ("cecill", "cecill", r"cecill(?: free software)?", ("1 0", "1 1", "2 0", "2 1")),
    ("mulan", "mulan permissive", r"mulan permissive software", ("1 0", "2 0")),
    ("blueoak", "blue oak", r"blue oak model", ("1 0 0",)),
)

#: Headers of the GNU licenses: label stem, name pattern, versions.
_GNU = (
    ("gpl", r"gnu general public", ("1 0", "2 0", "3 0")),
    ("lgpl", r"gnu (?:lesser|library) general public", ("2 0", "2 1", "3 0")),
    ("agpl", r"gnu affero general public", ("1 0", "3 0")),
)

#: Short names as identifiers: name, versions.
_SHORT = (
    ("gpl", ("1 0", "2 0", "3 0")), ("lgpl", ("2 0", "2 1", "3 0")), ("agpl", ("1 0", "3 0")), ("mpl", ("1 0", "1 1", "2 0")),
    ("epl", ("1 0", "2 0")), ("eupl", ("1 0", "1 1", "1 2")), ("cddl", ("1 0", "1 1")), ("gfdl", ("1 1", "1 2", "1 3")), ("osl", ("3 0",)), ("afl", ("3 0",)),
)

#: Licenses without versions: label, keyword, pattern, priority.
_PLAIN = (
    ("mit", "mit licen", rf"(?:the )?mit {_LICENSE}", 60),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 70),
    ("mit", "expat licen", rf"expat {_LICENSE}", 60),
    ("x11", "x11 licen", rf"x11 {_LICENSE}", 60),
    ("mit-0", "mit no attribution", rf"mit no attribution(?: {_LICENSE})?", 75),
    ("bsd-2-clause", "bsd", rf"(?:simplified|freebsd|2 clause|two clause) bsd(?: {_LICENSE})?", 75),
    ("bsd-2-clause", "bsd", rf"bsd (?:2|two) clause(?: {_LICENSE})?", 75),
    ("bsd-3-clause", "bsd", rf"(?:new|revised|modified|3 clause|three clause) bsd(?: {_LICENSE})?", 75),
    ("bsd-3-clause", "bsd", rf"bsd (?:3|three) clause(?: {_LICENSE})?", 75),
    ("bsd-4-clause", "bsd", rf"(?:original|old|4 clause|four clause) bsd(?: {_LICENSE})?", 75),
    ("bsd-4-clause", "bsd", rf"bsd (?:4|four) clause(?: {_LICENSE})?", 75),
    ("0bsd", "0bsd", r"0bsd", 75),
    ("0bsd", "zero clause", rf"zero clause bsd(?: {_LICENSE})?", 75),
    ("bsd", "bsd", rf"bsd (?:style )?{_LICENSE}", 50),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 65),
    ("bsd-3-clause", "neither the name", r"neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products", 80),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display", 85),
    ("bsd", "bsd", rf"governed by a bsd (?:style )?{_LICENSE}", 55),
    ("apache-2.0", "apache org", r"apache org licenses license 2 0", 90),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 95),
    ("isc", "isc licen", rf"isc {_LICENSE}", 60),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 65),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_LICENSE}", 60),
    ("boost-1.0", "boost software", rf"boost software {_LICENSE}", 60),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 60),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 70),
    ("wtfpl", "wtfpl", r"wtfpl", 60),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {_LICENSE}", 60),
    ("psf", "python software foundation", rf"python software foundation {_LICENSE}", 60),
    ("postgresql", "postgresql licen", rf"postgresql {_LICENSE}", 60),
    ("openssl", "openssl licen", rf"openssl {_LICENSE}", 60),
    ("ruby", "ruby licen", rf"ruby {_LICENSE}", 50),
    ("vim", "vim licen", rf"vim {_LICENSE}", 50),
    ("ms-pl", "microsoft public", rf"microsoft public {_LICENSE}", 60),
    ("ms-rl", "microsoft reciprocal", rf"microsoft reciprocal {_LICENSE}", 60),
    ("qpl", "q public", rf"q public {_LICENSE}", 60),
    ("beerware", "beer", rf"beer ?ware {_LICENSE}", 60),
    ("ijg", "independent jpeg", rf"independent jpeg group {_LICENSE}", 60),
    ("curl", "curl licen", rf"curl {_LICENSE}", 50),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", 60),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 75),
    ("cc0", "creative commons", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?", 80),
    ("cc", "creative commons", rf"creative commons(?: {_LICENSE})?", 30),
    ("public-domain", "public domain", r"(?:dedicated to|released (?:in)?to|placed in(?:to)?|in) the public domain", 40),
    ("public-domain", "public domain", r"public domain dedication", 45),
    ("proprietary", "rights reserved", r"all rights reserved", 40),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 40),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution)(?: or (?:copying|distribution))? (?:of this \S+ )?is (?:strictly )?prohibited", 45),
    ("proprietary", "end user licen", rf"end user {_LICENSE} agreement", 40),
)


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, confidence) in order; a keyword begins with a word in whatever its pattern matches."""
    out: list[tuple[str, str, str, int, float]] = []
    spec = lambda v: rf"{v[:-2]}(?: 0)?" if v.endswith(" 0") else v
    for stem, keyword, name, versions in _VERSIONED:
        for v in versions:
            label = f"{stem}-{v.replace(' ', '.')}"
            out.append((label, keyword, rf"{name} {_LICENSE}(?: \S{{2,9}})? {_VERSION}{spec(v)}", 90, 1.0))
            out.append((f"{label}-or-later", keyword, rf"{name} {_LICENSE}(?: \S{{2,9}})? {_VERSION}{spec(v)} or {_LATER}", 100, 1.0))
            out.append((label, keyword, rf"{_VERSION}{spec(v)} of the {name} {_LICENSE}", 90, 0.95))
            out.append((f"{label}-or-later", keyword, rf"{_VERSION}{spec(v)} or {_LATER} of the {name} {_LICENSE}", 100, 0.95))
        out.append((stem, keyword, rf"{name} {_LICENSE}", 60, 0.8))
    for stem, name, versions in _GNU:
        for v in versions:
            label = f"{stem}-{v.replace(' ', '.')}"
            header = rf"{name} {_LICENSE} as published by the free software foundation(?: inc)?(?: either)? version {spec(v)}(?: of the {_LICENSE})?"
            out.append((f"{label}-or-later", "general public", rf"{header} or {_LATER}", 105, 1.0))
            out.append((f"{label}-only", "general public", rf"{header}(?: only)?", 95, 0.95))
    for stem, versions in _SHORT:
        for v in versions:
            label = f"{stem}-{v.replace(' ', '.')}"
            out.append((label, stem, rf"{stem} ?{_VERSION}{spec(v)}", 85, 0.9))
            out.append((f"{label}-or-later", stem, rf"{stem} ?{_VERSION}{spec(v)} or {_LATER}", 95, 0.95))
            out.append((f"{label}-only", "spdx", rf"spdx license identifier {stem} {spec(v)} only", 110, 1.0))
        out.append((stem, stem, rf"{stem} {_LICENSE}", 55, 0.7))
        out.append((stem, stem, rf"under (?:the )?(?:terms of the )?{stem}", 55, 0.7))
    for kind in _CC_KINDS:
        long = " ".join(_CC_LONG[x] for x in kind.split())
        stem = f"cc-{kind.replace(' ', '-')}"
        rank = kind.count(" ")
        for v in _CC_VERSIONS:
            label = f"{stem}-{v.replace(' ', '.')}"
            out.append((label, "cc by", rf"cc {kind} {_VERSION}{spec(v)}", 90 + rank, 0.95))
            out.append((label, "creative commons", rf"creative commons {long} {_VERSION}{spec(v)}(?: (?:international|unported|generic))?(?: {_LICENSE})?", 90 + rank, 1.0))
            out.append((label, "creativecommons", rf"creativecommons org licenses {kind} {spec(v)}", 90 + rank, 1.0))
        out.append((stem, "cc by", rf"cc {kind}", 60 + rank, 0.8))
        out.append((stem, "creative commons", rf"creative commons {long}(?: {_LICENSE})?", 60 + rank, 0.9))
    for label, keyword, pattern, priority in _PLAIN:
        out.append((label, keyword, pattern, priority, 0.5 + priority / 200))
    return [(a, b, rf"(?<= ){c}(?= )", d, e) for a, b, c, d, e in out]


def _keywords() -> list[str]:
    """The beginnings of words that the coarse test looks for; each rule and phrase has one in its matches."""
    needed = {f" {k}" for _, k, _, _, _ in rules()} | {" license", " cc by"}
    return sorted(k for k in needed if not any(o != k and k.startswith(o) for o in needed))


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Words of a piece that is scanned at a time, and words that no match exceeds: a piece is read with so many before it and twice as many behind it.
PIECE, LONGEST = 256, 48

# of a piece x (s its words between single spaces, o the number of its first word): matches as intervals of its characters
_SPANS = r"""
flatten(transform(flatten(transform(filter({keywords}, k -> contains(x.s, k)), k -> element_at({rules}, k))), r ->
  transform(regexp_extract_all(x.s, r.pattern, 0), (m, i) -> struct(
    cast(aggregate(slice(split(x.s, r.pattern, -1), 1, i + 1), 0, (a, p) -> a + length(p))
      + aggregate(slice(regexp_extract_all(x.s, r.pattern, 0), 1, i), 0, (a, p) -> a + length(p)) AS int) AS a,
    length(m) AS n, length(m) - length(replace(m, ' ', '')) + 1 AS words, r.label AS label, r.priority AS priority, r.confidence AS confidence, r.rank AS rank))))
"""

_LEFT = """
filter(z.spans, x -> NOT exists(z.spans, y -> y.a <= x.a AND y.a + y.n >= x.a + x.n AND (
  y.priority > x.priority OR (y.priority = x.priority AND (y.n > x.n OR (y.n = x.n AND y.rank < x.rank))))))
"""

# the matches left of a piece that begin in its own words, as intervals of the text's words
_OWN = """
filter(transform(x.found, y -> struct(
  cast(x.o + length(substring(x.s, 1, y.a)) - length(replace(substring(x.s, 1, y.a), ' ', '')) - 1 AS long) AS start, y.words, y.label, y.priority, y.confidence)),
  y -> y.start >= x.c * {piece} AND y.start < (x.c + 1) * {piece})
"""


def _found(words: str, gate: str, rules_: str, keywords: str) -> str:
    """SQL for the detections of an array of words. Pieces overlap by more than a match can reach, so each match has all in its piece that may suppress it."""
    low = f"greatest(0, c * {PIECE} - {LONGEST})"
    pieces = f"transform(sequence(0, cast((size(w) - 1) div {PIECE} as int)), c -> struct(c, {low} AS o, concat(' ', array_join(slice(w, {low} + 1, c * {PIECE} + {PIECE + 2 * LONGEST} - {low}), ' '), ' ') AS s))"
    spans = f"transform(filter({pieces}, x -> rlike(x.s, {gate})), x -> struct(x.c, x.o, x.s, {_SPANS.format(rules=rules_, keywords=keywords)} AS spans))"
    left = f"transform({spans}, z -> struct(z.c, z.o, z.s, {_LEFT} AS found))"
    own = f"flatten(transform({left}, x -> {_OWN.format(piece=PIECE)}))"
    # the words are bound by a lambda, so that they are split once
    return f"element_at(transform(array({words}), w -> array_sort(transform({own}, y -> struct(y.start, y.start + y.words AS end, y.label, y.priority, y.confidence)))), 1)"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections."""
    by_keyword: dict[str, list[str]] = {}
    for i, (label, keyword, pattern, priority, confidence) in enumerate(rules()):
        by_keyword.setdefault(f" {keyword}", []).append(
            f"named_struct('label', {_text(label)}, 'pattern', {_text(pattern)}, 'priority', {priority}, 'confidence', {confidence:.4f}D, 'rank', {i})"
        )
    table = "map(" + ", ".join(f"{_text(k)}, array({', '.join(v)})" for k, v in by_keyword.items()) + ")"
    keywords = "array(" + ", ".join(map(_text, by_keyword)) + ")"
    outputs = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = dict(zip(("flat", "s", "n", "base", "first", "last", "names", "found"), unused(docs, "flat", "s", "n", "base", "first", "last", "names", "found")))
    # words with A-Z still in their own case: the class with A-Z besides a-z
    flat = F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    keyword = " (?:" + "|".join(k[1:] for k in _keywords()) + ")"
    gate = F.rlike(F.concat(F.lit(" "), F.lower(own["flat"])), F.lit(keyword))
    ascii_lower = F.translate(own["flat"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = docs.withColumn(own["flat"], flat).withColumn(own["s"], F.when(gate, F.concat(F.lit(" "), ascii_lower, F.lit(" "))))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    s, double = F.col(own["s"]), F.replace(F.col(own["s"]), F.lit(" "), F.lit("  "))
    counts, firsts, lasts, names = [], [], [], []
    for phrase, label in BASE:
        once, twice = F.lit(f" {phrase} "), f" {phrase.replace(' ', '  ')} "
        n = ((F.length(double) - F.length(F.replace(double, F.lit(twice), F.lit("")))) / len(twice)).cast("long")
        has = F.contains(s, once)
        counts.append(F.when(has, n).otherwise(F.lit(0)))
        firsts.append(F.when(has, spaces(F.substring_index(s, f" {phrase} ", 1))))
        tail = spaces(F.substring_index(s, f" {phrase} ", -1))  # the words behind the last place
        lasts.append(F.when(has, spaces(s) - tail - 1 - F.lit(len(phrase.split()))))
        names.append(F.when(has, F.lit(label)))
    out = out.withColumns({
        own["n"]: F.when(F.col(own["flat"]) == "", 0).otherwise(spaces(F.col(own["flat"])) + 1).cast("long"),
        own["base"]: sum(counts[1:], counts[0]).cast("long"), own["first"]: F.least(*firsts).cast("long"), own["last"]: F.greatest(*lasts).cast("long"),
        own["names"]: F.array_compact(F.array(*names)),
        own["found"]: F.when(s.isNotNull(), F.expr(_found(f"split(trim({own['s']}), ' ')", _text(keyword), table, keywords))),
    })
    join: Column = F.array_join(F.array_sort(F.array_distinct(own["names"])), ",")
    labels = F.coalesce(F.expr(f"transform({own['found']}, x -> x.label)"), F.array().cast("array<string>"))
    both = F.array_join(F.array_sort(F.array_distinct(F.concat(own["names"], labels))), ",")
    results = {
        "n_words": F.col(own["n"]), "n_base": F.coalesce(own["base"], F.lit(0).cast("long")), "first_word": F.col(own["first"]), "last_word": F.col(own["last"]),
        "base_labels": join, "labels": both, "score": F.coalesce(F.expr(f"array_max(transform({own['found']}, x -> x.confidence))"), F.lit(0.0)),
        "detections": F.coalesce(own["found"], F.expr("array()").cast("array<struct<start:long,end:long,label:string,priority:int,confidence:double>>")),
    }
    return out.select(*[F.col(c) for c in docs.columns if c.lower() not in outputs], *[v.alias(k) for k, v in results.items()])
