"""Language identification in two steps: the family, then pairwise SVMs within it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 12
#: Bound of the training sample, all languages together.
MAX_DOCS = 4_000
# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc la co",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv", "uralic": "fi et hu", "celtic": "ga gd cy br", "turkic": "tr az kk uz ky",
    "semitic": "ar he am mt", "indic": "hi bn ur pa gu mr ne si", "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml", "malayic": "id ms jv su tl", "hellenic": "el", "sinitic": "zh",
    "japonic": "ja", "koreanic": "ko", "vietic": "vi", "tai": "th lo", "caucasian": "ka hy",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
# Letters stay, bytes of non-ASCII characters too, everything else is a space.
_PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], "other")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits, fractions and raised numbers are none."""
    return any(map(str.isalpha, text))


def vector(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams (1 to 3), a vector of unit length."""
    data = f" {text.lower()} ".encode().translate(_PLAIN)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    one = b * np.uint32(2654435761)
    two = one[:-1] * np.uint32(31) + b[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(31) + b[2:] * np.uint32(3266489917)
    codes = np.concatenate([one, two, three]) >> np.uint32(20)
    counts = np.bincount(codes, minlength=BUCKETS)
    return np.sqrt(counts / len(codes))


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 60, strength: float = 1e-3) -> np.ndarray:
    """Weights (bias last) of a linear SVM: squared hinge loss, averaged full-batch descent.

    ``y`` holds 1 and -1; both sides weigh the same whatever their sizes.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(epochs):
        ahead = w + 0.9 * speed
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = strength * ahead - 2 * (x.T @ (share * slack * y))
        speed = 0.9 * speed - 0.25 * grad
        w = w + speed
    return w


@dataclass
class Model:
    """One-against-rest machines for families, one-against-one machines within each."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    by_family: np.ndarray | None = None
    pairs: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    by_pair: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """A learned language and a score from 0 to 1; ``und`` and 0 without letters or a model."""
        if not self.families or not text or not has_letter(text):
            return "und", 0.0
        x = vector(text)
        at = np.flatnonzero(x)
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            margins = x[at] @ self.by_family[at] + self.by_family[-1]
            best = int(np.argmax(margins))
            family, sure = self.families[best], _squash(margins[best])
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], sure
        margins = x[at] @ self.by_pair[family][at] + self.by_pair[family][-1]
        votes, weight = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (a, b), m in zip(self.pairs[family], margins):
            votes[a if m >= 0 else b] += 1
            weight[a] += m
            weight[b] -= m
        lang = max(langs, key=lambda k: (votes[k], weight[k]))
        closest = min(m if a == lang else -m for (a, b), m in zip(self.pairs[family], margins) if lang in (a, b))
        return lang, sure * _squash(closest)


def _squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-3 * np.clip(margin, -10, 10))))


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Fit the family machines, then one machine for each pair of languages of a family."""
    known = sorted(set(langs))
    if not known:
        return Model()
    own = np.array(langs)
    family = np.array([family_of(k) for k in langs])
    families = sorted(set(family))
    model = Model(families, {f: [k for k in known if family_of(k) == f] for f in families})
    if len(families) > 1:
        model.by_family = np.stack([fit_svm(x, np.where(family == f, 1, -1)) for f in families], axis=1)
    for f, members in model.members.items():
        if len(members) > 1:
            model.pairs[f] = list(combinations(members, 2))
            columns = []
            for a, b in model.pairs[f]:
                rows = np.isin(own, (a, b))
                columns.append(fit_svm(x[rows], np.where(own[rows] == a, 1, -1)))
            model.by_pair[f] = np.stack(columns, axis=1)
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    Every language gets the same share of ``max_docs``, thinned by a hash of
    the id. Texts without letters and rows without lang or id teach nothing.
    The languages of the corpus are counted first; their number is bounded by
    that of the world's languages.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), F.col("text")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
        & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    share = F.create_map(*[F.lit(v) for lang, n in counts.items()
                           for v in (lang, int(1_000_000 * min(1.0, max_docs / len(counts) / n)) + 1)])
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share[F.col("lang")])

    def measure(batches):
        for batch in batches:
            rows = [(lang, vector(text).astype("<f4").tobytes())
                    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if has_letter(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.binary())], names=["lang", "x"])

    rows = sorted(((r["lang"], bytes(r["x"])) for r in sample.select("lang", "text").mapInArrow(
        measure, "lang string, x binary").collect()))
    x = np.frombuffer(b"".join(r[1] for r in rows), "<f4").reshape(-1, BUCKETS)
    return fit(x, [r[0] for r in rows])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key, held_out, lang_pred and score of every row; whole texts, no shuffle.

    Null texts and texts without a letter are ``und`` with score 0. Repeated
    rows are judged each on its own; other columns are ignored.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def batches(rows):
        for batch in rows:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return source.mapInArrow(batches, "doc_id long, lang_pred string, score double").select(
        F.col("doc_id").alias(key), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
