import re
from dataclasses import replace
from itertools import islice, product
from re import _parser

from millrace.llm import licenses as op

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_base(text):
    words = words_of(text)
    places = sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(words))
                    if words[i:i + len(phrase.split())] == phrase.split())
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({label for _, label in places})))


def brute_found(text, table):
    """Every rule on every text, then pairwise suppression."""
    line = f" {' '.join(words_of(text))} "
    every = []
    for i, rule in enumerate([*op.BASE, *table]):
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", line):
            start = line[:m.start()].count(" ") - 1
            every.append((start, start + m[0].count(" ") + 1, rule.priority, i, rule.label))

    def beaten(d):
        return d[2] and any(e is not d and e[0] <= d[0] and e[1] >= d[1] and (
            e[2] < d[2] or e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3])) for e in every)

    return sorted((d for d in every if not beaten(d)), key=lambda d: (d[0], -d[1], d[2], d[3]))


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.",
    "CC BY cc-by Cc By-SA 4.0 ALL RIGHTS RESERVED. all rights reserved All Rights reserved",
    "Licensed under the Apache License, Version 2.0 (the License); Apache-2.0 or later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. MIT License",
    "GNU Lesser General Public License v2.1 or later; LGPL-2.1-only; GPLv3; gpl 2 only",
    "Copyright (c) 2020 Some Body. All rights reserved. BSD-3-Clause license",
    "general public licenſe general  public\tlicense", "all rights reserved " * 300, "", None, "...", "mit der Zeit",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "é cc by é Tous droits réservés",
]


def check(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = op.scan(docs).collect()
    base = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                   for r in got), key=repr)
    assert base == sorted(((d, *brute_base(t)) for d, t in texts), key=repr)
    for r in got:
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_documents(documents, odd_docs, no_docs):
    check(documents)
    check(odd_docs)
    assert op.scan(no_docs).collect() == []


def test_detections_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check(docs)
    table = op.signatures()
    for r in op.detections(docs).collect():
        got = [(d["start"], d["end"], d["priority"], d["rule"], d["label"]) for d in r["found"]]
        assert got == brute_found(TEXTS[r["doc_id"]], table), TEXTS[r["doc_id"]]


def test_table(documents):
    table = op.signatures()
    assert len(table) > 500 and len(op.PHRASES + op.NOTICES) > 240
    for rule in table:
        re.compile(rule.pattern)
        assert rule.keyword == rule.keyword.lower()
    plan = op.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert plan.count(" lower(") == 1  # the text is lower-cased once, not once for each keyword
    keywords = sorted({r.keyword for r in [*op.BASE, *table]})
    tree = op.fragments(keywords)
    assert sorted(k for held in tree.values() for k in held) == keywords
    assert all(part in k and len(part) <= 10 or held == [part] for part, held in tree.items() for k in held)


def variants(parsed):
    """All strings of a parsed pattern: each option, letter of a class and branch; least repeats of longer runs."""
    parts = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append([chr(v) for k, v in value if str(k) == "LITERAL"] or [
                "7" if "DIGIT" in str(value) else "x"])
        elif name == "BRANCH":
            parts.append([s for branch in value[1] for s in variants(branch)])
        elif name == "SUBPATTERN":
            parts.append(variants(value[3]))
        elif name == "MAX_REPEAT":
            low, high, inner = value
            counts = (0, 1) if (low, high) == (0, 1) else (low,)
            parts.append([s for n in counts for s in map("".join, product(variants(inner), repeat=n))])
        else:
            raise ValueError(name)
    return list(map("".join, islice(product(*parts), 5000)))


def test_every_match_holds_its_keyword():
    for rule in [*op.BASE, *op.signatures()]:
        for text in variants(_parser.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, text) and rule.keyword in f" {text} ", (rule, text)
            assert rule.also in f" {text} ", (rule, text)


def test_each_signature_alone(spark):
    """The scan finds what it finds where every rule runs on every text."""
    table = op.signatures()
    texts = [variants(_parser.parse(r.pattern))[-1] for r in table]
    texts += ["EUPL-1.2", "OSL 3.0", "AFL-2.1 or later", "BSL-1.0", "ODbL 1.0", "OFL-1.1 only", "ZPL 2.1",
              "licenced under MIT", "licenced under terms", "Unauthorised copying", "Apache Software Licence"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got, want = ({r["doc_id"]: r["found"] for r in op.detections(docs, table=rules).collect()}
                 for rules in (table, [replace(r, keyword="", also="") for r in table]))
    assert got == want and all(got.values())


def test_one_word_versions(spark):
    want = {"GPLv2": "gpl-2", "GPLv3": "gpl-3", "LGPLv3": "lgpl-3", "AGPLv3": "agpl-3", "MPLv2": "mpl-2",
            "gpl3": "gpl-3", "LGPLv2.1 or later": "lgpl-2.1-or-later", "GPLv2 only": "gpl-2-only"}
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in op.scan(docs).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_notices(spark):
    """Sentences as users of licenses write them, each with the label it must get."""
    want = {
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS": "apache-2",
        "See http://www.apache.org/licenses/LICENSE-2.0": "apache-2",
        "You should have received a copy of the GNU Lesser General Public License along with this library": "lgpl",
        "either version 2 of the License, or (at your option) any later version.": "gpl-2-or-later",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.": "mit",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.": "bsd",
        "The Software shall be used for Good, not Evil.": "json",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
        "Contains public sector information licensed under the Open Government Licence v3.0.": "ogl",
        "You may copy it, give it away or re-use it under the terms of the Project Gutenberg License": "gutenberg",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "ofl",
        "Licensed under the EUPL, Version 1.2": "eupl", "Server Side Public License, version 1": "sspl",
        "for non-commercial use only": "non-commercial", "Elastic License 2.0": "elastic",
        "End-User License Agreement": "proprietary", "Tutti i diritti riservati": "reserved",
        "CeCILL-B": "cecill", "GNU Free Documentation License 1.3": "gfdl-1.3",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in op.scan(docs).collect()}
    assert [(t, got[i]) for i, (t, label) in enumerate(want.items()) if label not in got[i]] == []


def test_plain_texts_get_no_label(spark):
    texts = ["The author of the software wrote without a purpose, under terms of use nobody reads before breakfast.",
             "The public library is open; a source said that subjects were provided with written notes.",
             "A fair price for every use, and freedom for the reader."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["labels"] for r in op.scan(docs).collect()} == {""}
