import zlib

import numpy as np

from millrace.llm import pu_quality as op
from millrace.llm.quality_rules import STOP_WORDS

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = op.scores(docs, op.learn(docs, labels))
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    tested = got.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r[0] == r[1] for r in tested) / len(tested) > 0.95
    good = [r[0] for r in tested if r[1] == 1]
    assert sum(good) / len(good) > 0.97


def test_accuracy_does_not_depend_on_the_number_of_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = []
    for share in (1, 4):
        model = op.learn(docs, labels.where(f"doc_id % {share} = 0"))
        tested = op.scores(docs, model).where("held_out").join(labels, "doc_id").selectExpr("predicted = quality AS right")
        found.append(np.mean([r["right"] for r in tested.collect()]))
    assert min(found) > 0.985 and abs(found[0] - found[1]) < 0.005, found


def plain_features(text):
    """Every measure of ``NAMES`` again, by loops over the bytes, words and lines of a text."""
    words, lines, word = [], [[]], []
    for byte in text.encode() + b" ":
        if byte in b" \t\n\r\x0b\x0c":
            if word:
                words.append(bytes(word))
            word = []
        else:
            word.append(byte)
        if byte == 10:
            lines.append([])
        else:
            lines[-1].append(byte)
    lines[-1].pop()
    lines = [bytes(line) for line in lines if any(b not in b" \t\r\x0b\x0c" for b in line)]
    if not words:
        return [0.0] * len(op.NAMES)
    n, letters, upper, digits, symbols, stoppers, exclamations, size = len(words), 0, 0, 0, 0, 0, 0, 0
    for byte in text.encode():
        letters += 65 <= byte <= 90 or 97 <= byte <= 122 or byte >= 128
        upper += 65 <= byte <= 90
        digits += 48 <= byte <= 57
        symbols += chr(byte) in "#*$%&|<>~^_={}[]\\@+`"
        stoppers += chr(byte) in ".,;:?!\"'()-/"
        exclamations += chr(byte) == "!"
    stops, stutter, seen = 0, 0, []
    for i, word in enumerate(words):
        size += len(word)
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        stops += low.decode(errors="replace") in " ".join(STOP_WORDS.values()).split()
        stutter += i > 0 and low == words[i - 1].lower()
        if low not in seen:
            seen.append(low)
    repeated = sum(line in lines[:i] for i, line in enumerate(lines))
    tanh = lambda x: np.tanh(3 * x)
    return [np.log(1 + n) / 5, min(3, size / n / 10), tanh(upper / max(1, letters)), min(1, digits / n),
            tanh(symbols / n), min(2, stoppers / n), tanh(exclamations / n), stops / n,
            min(1, len(seen) / n ** 0.8), tanh(stutter / n), repeated / len(lines),
            min(3, np.log(1 + n / len(lines)) / 3)]


def test_features_match_plain_loops(spark):
    texts = ["", " \n ", "one", "The cat sat. The cat sat!\nThe cat sat.\n\n" * 3, "a1 #b $c <d> &amp; 1234 ABC abc",
             "é ü ñ " * 9, "\t x\r\ny  y Y y\x0bz [a]{b}\\@+` \"'()-/"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200").collect()]
    for text in texts:
        assert np.allclose(op.features(text.encode()), plain_features(text), rtol=0, atol=1e-12), text[:80]
    assert op.features(None) == op.features(b"")


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(5)
    p, u = (np.append(rng.normal(m, 1, (50, 3)), np.ones((50, 1)), axis=1) for m in (1, 0))
    for w in (np.zeros(4), rng.normal(0, 1, 4), np.array([3.0, -2.0, 1.0, 0.5])):
        grads = op.risks(w, p, u, 0.4)[2:]
        for i in range(4):
            step = np.eye(4)[i] * 1e-6
            ahead, back = op.risks(w + step, p, u, 0.4)[:2], op.risks(w - step, p, u, 0.4)[:2]
            for k in (0, 1):
                assert abs((ahead[k] - back[k]) / 2e-6 - grads[k][i]) < 1e-6


def test_gradient_step_lowers_the_risk():
    """Fitting lowers the non-negative risk, computed by loops."""
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (300, 2)), np.concatenate([rng.normal(1, 1, (200, 2)), rng.normal(-1, 1, (200, 2))])

    def risk(w, prior=0.5):
        def loss(x, sign):
            return float(np.mean([1 / (1 + np.exp(sign * (row @ w[:-1] + w[-1]))) for row in x]))

        return prior * loss(p, 1) + max(0.0, loss(u, -1) - prior * loss(p, -1))

    assert risk(op.fit_nnpu(p, u, 0.5)) < 0.6 * risk(np.zeros(3))


def test_held_out_labels_and_columns_never_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 5 = 0, 1 - quality, quality) AS quality")
    a, b = (op.learn(docs, t) for t in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    p = rng.normal(1.5, 1, (4000, 1))
    for prior in (0.3, 0.8):
        n = int(6000 * prior)
        u = np.concatenate([rng.normal(1.5, 1, (n, 1)), rng.normal(-2.5, 1, (6000 - n, 1))])
        assert abs(op.estimate_prior(p[:, 0], u[:, 0]) - prior) < 0.06
        w = op.fit_nnpu(p, u, prior)
        called = u[:, 0] * w[0] + w[1] > 0
        assert (called[:n].mean() > 0.93) and (called[n:].mean() < 0.07)


def test_odd_rows(odd_docs, no_docs, no_labels, spark):
    model = op.learn(odd_docs, no_labels)
    assert model.weights is None
    assert {(r["score"], r["predicted"]) for r in op.scores(odd_docs, model).collect()} == {(0.5, 1)}
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 1, 0), (3, 0, 0), (None, 1, 0), (6, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = op.learn(odd_docs, labels)
    assert op.scores(odd_docs, model).count() == odd_docs.count()
    assert op.scores(no_docs, model).collect() == []
    assert op.keep_good(odd_docs, model).schema == odd_docs.schema
    assert op.keep_good(no_docs, model).collect() == []
