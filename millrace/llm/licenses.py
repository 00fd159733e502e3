"""License scans: ordered signature rules over the words of a text, built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.license_notices import HINT, NAME, NOTICES, TEXT, VERSIONED

#: Everything but digits, ASCII letters and non-ASCII characters parts words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: By rule order: whole license texts before names with a version, names, and mere hints.
WEIGHTS = {0: 0.7, TEXT: 1.0, VERSIONED: 0.9, NAME: 0.7, HINT: 0.4}

#: Words of keywords that many other texts hold too.
FREQUENT = ("under", "terms", "without", "author", "authors", "source", "software", "purpose", "purposes", "subject",
            "written", "provided", "before")


@dataclass(frozen=True)
class Signature:
    """``pattern`` is matched against lower-case words joined by single spaces, at word borders.

    Every match, with the spaces around it, must contain ``keyword`` and ``also``.
    """

    label: str
    priority: int
    keyword: str
    pattern: str
    also: str = ""


#: Base phrases; their labels are never suppressed.
BASE = (
    Signature("cc-by", 0, "cc by", "cc by"),
    Signature("gpl", 0, "general public license", "general public license"),
    Signature("reserved", 0, "all rights reserved", "all rights reserved"),
)

# License families as (label, keyword of the full name, full name, short name, versions);
# a short name is its own keyword.
FAMILIES = (
    ("gpl", "gpl", "", "gpl", "1 2 3"),
    ("gpl", "general public licen", "(?:gnu )?general public licen[cs]e", "", "1 2 3"),
    ("lgpl", "lgpl", "", "lgpl", "2 2.1 3"),
    ("lgpl", "general public licen", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "", "2 2.1 3"),
    ("agpl", "agpl", "", "agpl", "1 3"),
    ("agpl", "general public licen", "(?:gnu )?affero general public licen[cs]e", "", "1 3"),
    ("gfdl", "free documentation licen", "(?:gnu )?free documentation licen[cs]e", "", "1.1 1.2 1.3"),
    ("apache", "apache", "apache (?:software )?licen[cs]e", "apache", "1 1.1 2 2.0"),
    ("mpl", "mozilla public", "mozilla public licen[cs]e", "", "1 1.0 1.1 2 2.0"),
    ("mpl", "mpl", "", "mpl", "1 1.0 1.1 2 2.0"),
    ("epl", "eclipse public", "eclipse public licen[cs]e", "", "1 1.0 2 2.0"),
    ("epl", "epl", "", "epl", "1 1.0 2 2.0"),
    ("cddl", "common development and distribution", "common development and distribution licen[cs]e", "", "1 1.0 1.1"),
    ("cddl", "cddl", "", "cddl", "1 1.0 1.1"),
    ("cpl", "common public licen", "common public licen[cs]e", "", "1 1.0"),
    ("eupl", "european union public", "european union public licen[cs]e", "eupl", "1.0 1.1 1.2"),
    ("osl", "open software licen", "open software licen[cs]e", "osl", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free licen", "academic free licen[cs]e", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic licen", "artistic licen[cs]e", "", "1 1.0 2 2.0"),
    ("boost", "boost software licen", "boost software licen[cs]e", "bsl", "1 1.0"),
    ("busl", "business source licen", "business source licen[cs]e", "", "1.0 1.1"),
    ("odbl", "open database licen", "open database licen[cs]e", "odbl", "1 1.0"),
    ("ofl", "open font licen", "(?:sil )?open font licen[cs]e", "ofl", "1.0 1.1"),
    ("python", "python software foundation licen", "python software foundation licen[cs]e", "", "2"),
    ("zpl", "zope public licen", "zope public licen[cs]e", "zpl", "1.1 2.0 2.1"),
)
CC_PARTS = (("cc-by", "by", "attribution"),
            ("cc-by-sa", "by sa", "attribution share ?alike"),
            ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
            ("cc-by-nc", "by nc", "attribution non ?commercial"),
            ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
            ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

# Opening or telling phrases of license texts and notices, as (label, priority, keyword, pattern).
PHRASES = (
    ("mit", TEXT, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", NAME, "mit licen", "(?:the )?mit licen[cs]e"),
    ("mit", NAME, "ed under", "licen[cs]ed under (?:the )?mit"),
    ("expat", NAME, "expat", "expat licen[cs]e"),
    ("isc", TEXT, "permission to use copy modify", "permission to use copy modify and(?: or)? distribute this software for any purpose"),
    ("isc", NAME, "isc licen", "isc licen[cs]e"),
    ("bsd", TEXT, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", HINT, "endorse or promote", "neither the name of (?:\\S+ ){1,12}may be used to endorse or promote"),
    ("bsd-4", HINT, "advertising materials", "all advertising materials mentioning features or use of this software"),
    ("bsd", NAME, "bsd", "(?:new |modified |simplified |revised )?bsd (?:style )?licen[cs]e"),
    ("bsd-2", VERSIONED, "bsd", "(?:bsd 2 clause|2 clause bsd)(?: licen[cs]e)?"),
    ("bsd-3", VERSIONED, "bsd", "(?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
    ("bsd-4", VERSIONED, "bsd", "(?:bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    ("bsd-0", VERSIONED, "bsd", "(?:bsd zero clause|0bsd|zero clause bsd)(?: licen[cs]e)?"),
    ("apache-2", TEXT, "apache licen", "licen[cs]ed under the apache licen[cs]e version 2 0(?: the licen[cs]e)?"),
    ("apache", NAME, "apache", "apache (?:software )?licen[cs]e"),
    ("gpl", TEXT, "free software foundation", "under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("lgpl", TEXT, "free software foundation", "under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation"),
    ("agpl", TEXT, "free software foundation", "under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("lgpl", NAME, "general public licen", "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("agpl", NAME, "general public licen", "(?:gnu )?affero general public licen[cs]e"),
    ("gpl", NAME, "general public licen", "(?:gnu )?general public licen[cs]e"),
    ("gpl", HINT, "gpl", "(?:gnu )?gpl(?:ed)?"),
    ("lgpl", HINT, "lgpl", "(?:gnu )?lgpl"),
    ("agpl", HINT, "agpl", "(?:gnu )?agpl"),
    ("mpl", TEXT, "mozilla public", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", NAME, "mozilla public", "mozilla public licen[cs]e"),
    ("epl", TEXT, "eclipse public", "made available under the terms of the eclipse public licen[cs]e"),
    ("epl", NAME, "eclipse public", "eclipse public licen[cs]e"),
    ("cddl", NAME, "common development and distribution", "common development and distribution licen[cs]e"),
    ("zlib", TEXT, "altered source versions", "altered source versions must be plainly marked as such"),
    ("zlib", NAME, "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("boost", TEXT, "boost software licen", "distributed under the boost software licen[cs]e version 1 0"),
    ("boost", NAME, "boost software licen", "boost software licen[cs]e"),
    ("wtfpl", NAME, "wtfpl", "wtfpl"),
    ("unlicense", TEXT, "public domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", NAME, "unlicense", "(?:the )?unlicense"),
    ("public-domain", NAME, "public domain", "(?:dedicated|released|placed) (?:in|to|into) the public domain"),
    ("public-domain", HINT, "public domain", "public domain"),
    ("cc0", VERSIONED, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", TEXT, "creative commons", "creative commons (?:cc0|zero)(?: 1 0)? universal"),
    ("cc", HINT, "creative commons", "creative commons(?: licen[cs]e)?"),
    ("artistic", NAME, "artistic licen", "artistic licen[cs]e"),
    ("ofl", NAME, "open font licen", "(?:sil )?open font licen[cs]e"),
    ("odbl", NAME, "open database licen", "open database licen[cs]e"),
    ("proprietary", NAME, "proprietary", "proprietary and confidential"),
    ("proprietary", HINT, "unauthori", "unauthori[sz]ed (?:copying|use|reproduction|distribution)"),
    ("proprietary", NAME, "no part of this", "no part of this (?:\\S+ ){1,3}may be reproduced"),
    ("reserved", NAME, "all rights reserved", "copyright (?:c )?(?:\\d{4} )?(?:\\S+ ){0,6}all rights reserved"),
    ("reserved", NAME, "some rights reserved", "some rights reserved"),
    ("reserved", NAME, "alle rechte vorbehalten", "alle rechte vorbehalten"),
    ("reserved", NAME, "tous droits", "tous droits r[ée]serv[ée]s"),
    ("reserved", NAME, "todos los derechos", "todos los derechos reservados"),
    ("copyright", HINT, "copyright", "copyright (?:c )?(?:\\d{4} )?"
                                     "(?:by |of )?\\S+"),
    ("spdx", HINT, "spdx", "spdx licen[cs]e identifier \\S+"),
    ("license", HINT, "ed under", "licen[cs]ed under (?:the )?(?:terms of )?(?:the )?\\S+"),
)


def _number(version: str) -> str:
    return version.replace(".", " ")


def signatures() -> list[Signature]:
    """The whole table, a few hundred rules: phrases and notices as written, families and versions by rule."""
    table = [Signature(*row) for row in PHRASES + NOTICES]
    for label, keyword, full, short, versions in FAMILIES:
        for version in versions.split():
            number = _number(version)
            major = f"{label}-{version.removesuffix('.0')}"
            for name, key in ((full, keyword), (short, f" {short}")):
                if name:
                    table.append(Signature(major, VERSIONED, key, f"{name} (?:version |v )?{number}", number))
                    joint = " ?v?" if name == short else " v"  # short names also as one word: gplv3
                    table.append(Signature(major, VERSIONED, key, f"{name}{joint}{number}", number))
            if full:
                table.append(Signature(major, VERSIONED, keyword,
                                       f"version {number} (?:\\d+ )?of the {full}", f"version {number}"))
                table.append(Signature(f"{major}-or-later", VERSIONED, keyword,
                                       f"{full} (?:version |v ?)?{number}(?: 0)? or (?:any )?later(?: version)?", "later"))
            if short:
                table.append(Signature(f"{major}-or-later", VERSIONED, f" {short}",
                                       f"{short} ?(?:v ?)?{number}(?: 0)? or later", "or later"))
                table.append(Signature(f"{major}-only", VERSIONED, f" {short}",
                                       f"{short} ?(?:v ?)?{number}(?: 0)? only", " only"))
    for label, short, full in CC_PARTS:
        table.append(Signature(label, NAME, "cc by", f"cc {short}"))
        table.append(Signature(label, NAME, "creative commons", f"creative commons {full}"))
        for version in CC_VERSIONS.split():
            number = _number(version)
            table.append(Signature(f"{label}-{version}", VERSIONED, "cc by", f"cc {short} {number}", number))
            table.append(Signature(f"{label}-{version}", VERSIONED, "creative commons",
                                   f"creative commons {full} {number}(?: international| unported)?", number))
    return table


def _literal(table: list[Signature]) -> Column:
    return F.array(*[F.struct(
        F.lit(i).alias("rule"), F.lit(s.label).alias("label"), F.lit(s.priority).alias("priority"),
        F.lit(s.keyword).alias("keyword"), F.lit(s.also).alias("also"), F.lit(f"(?i)(?<= )(?:{s.pattern})(?= )").alias("pattern"))
        for i, s in enumerate(table)])


def fragments(keywords: list[str]) -> dict[str, list[str]]:
    """Strings of at most ten characters, each with the keywords that contain it; every keyword has one.

    A fragment holds five letters of one word, none of ``FREQUENT``, or is a whole keyword.
    """
    def parts(word: str) -> set[str]:
        cut = {word[i:i + n] for n in range(6, 11) for i in range(len(word) - n + 1)}
        return {c for c in cut if any(len(w) > 4 and not any(w in f for f in FREQUENT) for w in c.split())} | {word}

    left, chosen = {word: parts(word) for word in keywords}, {}
    while left:
        held: dict[str, int] = {}
        for word, own in left.items():
            for part in own:
                held[part] = held.get(part, 0) + 1
        best = min(held, key=lambda part: (-held[part], -len(part), part))
        chosen[best] = sorted(word for word in left if best in word)
        left = {word: own for word, own in left.items() if best not in word}
    return chosen


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def detections(docs: DataFrame, key: str = "doc_id", text: str = "text",
               table: list[Signature] | None = None) -> DataFrame:
    """Return key, n_words and ``found``, the detections that stand, a row per row of ``docs``.

    ``found`` is an array of (start, end, label, priority, rule) in text order;
    start and end count words from 0, end excluded. A rule's regular expression
    runs, once, only on texts that contain its keyword; on texts that contain
    no fragment of any keyword nothing else runs. A detection contained in one of the same or a stronger
    priority is suppressed (of equal ones the first in the table stands); base
    phrases always stand. Null and empty texts have no words and no detection;
    other columns are ignored. No shuffle; whole texts.
    """
    rules = list(BASE) + (signatures() if table is None else table)
    keywords = sorted({r.keyword for r in rules})
    plain = docs.select(F.col(key), F.trim(F.regexp_replace(
        F.coalesce(F.col(text), F.lit("")), GAP, " ")).alias("_plain"))
    worded = plain.select(key, F.when(F.col("_plain") == "", 0).otherwise(
        _spaces(F.col("_plain")) + 1).cast("long").alias("n_words"),
        F.concat(F.lit(" "), F.col("_plain"), F.lit(" ")).alias("_text"))
    lowered = worded.select(key, "n_words", "_text", F.lower("_text").alias("_lower"))
    # The lower-case text is used twice and more at each step, so that no step computes it again for every keyword.
    lower = F.col("_lower")
    tree = F.array(*[F.struct(F.lit(part).alias("part"), F.array(*map(F.lit, held)).alias("keywords"))
                     for part, held in fragments(keywords).items()])
    present = lowered.select(key, "n_words", "_text", "_lower", F.flatten(F.transform(
        F.filter(tree, lambda t: F.contains(lower, t["part"])),
        lambda t: F.filter(t["keywords"], lambda k: F.contains(lower, k)))).alias("_present"))
    hits = present.select(key, "n_words", F.when(F.size("_present") > 0, F.transform(
        F.filter(_literal(rules), lambda r: F.array_contains("_present", r["keyword"]) & F.contains(lower, r["also"])),
        lambda r: F.struct(
            r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"),
            F.split(F.regexp_replace("_text", r["pattern"], F.lit("\x01$0\x01")), "\x01").alias("pieces")))).alias("_hits"))
    # Text outside and inside of matches in turn; a match shares the spaces around it with what is outside.
    sized = hits.select(key, "n_words", F.transform(F.filter("_hits", lambda h: F.size(h["pieces"]) > 1), lambda h: F.struct(
        h["rule"].alias("rule"), h["label"].alias("label"), h["priority"].alias("priority"),
        F.transform(F.filter(h["pieces"], lambda p, i: i % 2 == 0), lambda p: _spaces(p) - 1).alias("gaps"),
        F.transform(F.filter(h["pieces"], lambda p, i: i % 2 == 1), lambda p: _spaces(p) + 1).alias("sizes")
    )).alias("_hits"))
    kind = "array<struct<start:int,end:int,priority:int,rule:int,label:string>>"
    none = F.array().cast(kind)

    def places(hit: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.get(hit["gaps"], i)
            end = start + F.get(hit["sizes"], i)
            return F.struct(end.alias("at"), F.array_append(acc["list"], F.struct(
                start.alias("start"), end.alias("end"), hit["priority"].alias("priority"),
                hit["rule"].alias("rule"), hit["label"].alias("label"))).alias("list"))

        return F.aggregate(F.sequence(F.lit(0), F.size(hit["sizes"]) - 1),
                           F.struct(F.lit(0).alias("at"), none.alias("list")), step, lambda acc: acc["list"])

    placed = sized.select(key, "n_words", F.coalesce(F.flatten(F.transform("_hits", places)), none).alias("_all"))
    # Text order, the longer first, then the stronger, then the earlier rule.
    ordered = placed.select(key, "n_words", F.transform(F.array_sort(F.transform("_all", lambda d: F.struct(
        d["start"], (-d["end"]).alias("back"), d["priority"], d["rule"], d["label"]))), lambda d: F.struct(
            d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"),
            d["rule"].alias("rule"), d["label"].alias("label"))).alias("_all"))

    def sweep(acc: Column, d: Column) -> Column:
        # reach[p]: how far the detections seen so far of priority p or stronger reach
        stands = (d["priority"] == 0) | (F.get(acc["reach"], d["priority"]) < d["end"])
        reach = F.transform(acc["reach"], lambda r, p: F.when(
            p >= d["priority"], F.greatest(r, d["end"])).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(stands, F.array_append(acc["list"], d)).otherwise(
            acc["list"]).alias("list"))

    return ordered.select(key, "n_words", F.aggregate("_all", F.struct(
        F.array(*[F.lit(0)] * 5).alias("reach"), none.alias("list")), sweep, lambda acc: acc["list"]).alias("found"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, first and last base place, labels and a score.

    ``score`` is the weight of the strongest detection (whole license text 1,
    name with version 0.9, name or base phrase 0.7, hint 0.4), 0 without one.
    Labels are distinct, sorted and comma-joined, an empty string without any.
    """
    found = detections(docs, key, text)
    base = F.filter("found", lambda d: d["priority"] == 0)

    def joined(items: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(items, lambda d: d["label"]))), ",")

    starts = F.transform("base", lambda d: d["start"])
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]),
                          F.array_min(F.transform("found", lambda d: F.when(
                              d["priority"] == 0, NAME).otherwise(d["priority"]))))
    return found.select(key, "n_words", "found", base.alias("base")).select(
        key, "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(weight, F.lit(0.0)).alias("score"))
