import zlib

import numpy as np

from millrace.llm import languages as op

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op.identify(docs, op.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in tested) / len(tested) > 0.97
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] in ("en", "de", "fr", "es", "und") and 0 <= r["score"] <= 1


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    turned = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id AS string)) % 4 = 2, 'xx', lang) AS lang")
    a, b = op.learn(docs), op.learn(turned)
    assert a.members == b.members and np.array_equal(a.by_family, b.by_family)


def test_odd_rows(odd_docs, no_docs):
    model = op.learn(odd_docs)
    got = op.identify(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    for doc in (1, 2, 4, 8):
        assert by_id[doc] == ("und", 0.0)
    assert by_id[7][0] in ("en", "de")
    assert op.identify(no_docs, model).collect() == []
    nothing = op.learn(no_docs)
    assert {r["lang_pred"] for r in op.identify(odd_docs, nothing).collect()} == {"und"}


def test_families_and_pairs():
    rng = np.random.default_rng(2)
    langs = ["en", "de", "nl", "fr", "es", "ru", "tlh"] * 20
    centres = {k: rng.random(op.BUCKETS) for k in set(langs)}
    x = np.stack([centres[k] + 0.05 * rng.random(op.BUCKETS) for k in langs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = op.fit(x, langs)
    assert model.members == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "slavic": ["ru"], "other": ["tlh"]}
    assert len(model.pairs["germanic"]) == 3 and "slavic" not in model.pairs


def test_signs_that_are_no_letters():
    assert not any(map(op.has_letter, ("", "12 ½ ² _ ٣", "!?")))
    assert op.has_letter("1 é") and op.has_letter("字")


def plain_vector(text):
    """Hashed byte n-grams by loops, counted in a dict."""
    data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode()]
    counts, total = {}, 0
    for i in range(len(data)):
        codes = [data[i] * 2654435761]
        if i + 1 < len(data):
            codes.append(codes[0] * 31 + data[i + 1] * 2246822519)
        if i + 2 < len(data):
            codes.append(codes[1] * 31 + data[i + 2] * 3266489917)
        for code in codes:
            bucket = code % 2 ** 32 >> 20
            counts[bucket] = counts.get(bucket, 0) + 1
            total += 1
    return {bucket: (n / total) ** 0.5 for bucket, n in counts.items()}


def plain_predict(model, text):
    """The family of the largest margin, then one vote for each pair of its languages."""
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    x = plain_vector(text)
    margin = lambda machines, j: sum(v * machines[b, j] for b, v in x.items()) + machines[-1, j]
    squash = lambda m: 1 / (1 + np.exp(-3 * min(10, max(-10, m))))
    family, sure = model.families[0], 1.0
    if len(model.families) > 1:
        margins = [margin(model.by_family, j) for j in range(len(model.families))]
        family, sure = model.families[margins.index(max(margins))], squash(max(margins))
    best = None
    for lang in model.members[family]:
        votes, weight, least = 0, 0.0, None
        for j, (a, b) in enumerate(model.pairs.get(family, [])):
            if lang in (a, b):
                m = margin(model.by_pair[family], j)
                own = m if lang == a else -m
                votes, weight = votes + (own > 0 or own == 0 and lang == a), weight + own
                least = own if least is None else min(least, own)
        score = sure if least is None else sure * squash(least)
        if best is None or (votes, weight) > best[:2]:
            best = (votes, weight, lang, score)
    return best[2:]


def test_predictions_match_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op.learn(docs)
    texts = [r["text"] for r in docs.where("doc_id % 23 = 0").collect()]
    texts += ["", "1 2 3", "É", "x", "der die das the of and", "字 и й", "A" * 3000]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op.identify(found, model).collect()}
    for i, text in enumerate(texts):
        lang, score = plain_predict(model, text)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, text[:80]


def test_machines_minimise_the_squared_hinge():
    """No small step in any direction lowers the loss by more than the descent left over."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0.5, 1, (40, 3)), rng.normal(-0.5, 1, (10, 3))])
    y = np.array([1] * 40 + [-1] * 10)

    def loss(w):
        total = 0.5e-3 * float(w @ w)
        for row, sign in zip(x, y):
            slack = max(0.0, 1 - sign * (float(row @ w[:-1]) + w[-1]))
            total += (0.5 / 40 if sign > 0 else 0.5 / 10) * slack ** 2
        return total

    w = op.fit_svm(x, y, epochs=400)
    assert loss(w) < loss(np.zeros(4))
    for _ in range(50):
        assert loss(w + rng.normal(0, 0.01, 4)) > loss(w) - 1e-6
