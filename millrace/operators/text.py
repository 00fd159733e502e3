"""TF-IDF weights, search and recommendation over a text column.

The work on one document happens in its own row: its tokens are sorted and run
lengths give the term counts, so weights and similarities need no shuffle. The
only shuffles are the corpus-wide term counts, which combine on the map side,
and the final top-k. A column that a lambda needs is computed in a projection
of its own and used twice in the next one, since Spark merges projections whose
columns are used once and would then recompute it for every array element.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import vector_kernels as kernels
from millrace.functions.vector_kernels import SCORE_PLACES
from millrace.operators.ranking import best_per_id, top_n_per_group
from millrace.sources.shared import shared_folder

#: Bands of weights, and slices of documents, over which a term's postings spread.
_BANDS = 16
#: About as many classes of one term are scored against as many others by one task at a time.
_SLICE = 8192
# Two or more letters, digits or underscores of any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


@dataclass(frozen=True)
class TextModel:
    """A fitted vocabulary: at most ``max_features`` terms with their idf."""

    idf: dict[str, float]
    stop_words: tuple[str, ...]
    bigrams: bool


def default_stop_words() -> list[str]:
    """Spark's English stop word list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def _with_tokens(docs: DataFrame, text: str, stop_words: Sequence[str],
                 bigrams: bool) -> DataFrame:
    """Adds ``_tokens``: the terms of the row's whole text, repeats included."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(*stop_words))
    df = docs.withColumn("_tokens", tokens)
    if bigrams:
        pairs_end = F.greatest(F.size("_tokens") - 1, F.lit(0))
        pairs = F.zip_with(F.slice("_tokens", 1, pairs_end), F.slice("_tokens", 2, pairs_end),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        df = df.withColumn("_tokens", F.concat(F.col("_tokens"), pairs))
    return df


def _with_counts(df: DataFrame) -> DataFrame:
    """Replaces ``_tokens`` by ``term_counts``: a struct (term, n) per distinct term."""
    df = df.withColumn("_tokens", F.sort_array("_tokens"))
    size = F.size("_tokens")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (
        F.get(F.col("_tokens"), i) != F.get(F.col("_tokens"), i - 1)))
    df = df.withColumn("_starts", starts)
    runs = F.transform("_starts", lambda s, i: F.struct(
        F.get(F.col("_tokens"), s).alias("term"),
        (F.coalesce(F.get(F.col("_starts"), i + 1), F.size("_tokens")) - s).alias("n")))
    return df.withColumn("term_counts", runs).drop("_tokens", "_starts")


def _rows(df: DataFrame, column: str, name: str) -> DataFrame:
    """Explode an array computed in the same row.

    A plain ``explode`` makes Spark push a test of the array's size down to the
    scan, which would evaluate the whole token expression once per token there.
    """
    return df.select(F.explode_outer(column).alias(name)).filter(F.col(name).isNotNull())


def count_terms(docs: DataFrame, text: str, stop_words: Sequence[str] | None = None,
                bigrams: bool = False) -> DataFrame:
    """Adds ``term_counts``: a struct (term, n) per distinct term of the row's whole text.

    The one costly step; a corpus that is both fitted and weighed is counted once and stored (``fit_weighed``).
    """
    words = default_stop_words() if stop_words is None else stop_words
    return _with_counts(_with_tokens(docs, text, words, bigrams))


def vocabulary(counted: DataFrame, max_features: int = 128, max_df: float = 1.0) -> DataFrame:
    """The most frequent terms (ties by term) of counted documents, with document count, total and idf.

    Terms in more than ``max_df`` of the documents are left out first.
    """
    n = counted.agg(F.count("*")).scalar()
    per_term = _rows(counted, "term_counts", "c").groupBy("c.term").agg(
        F.count("*").alias("df"), F.sum("c.n").alias("total"))
    if max_df < 1.0:
        per_term = per_term.filter(F.col("df") <= n * F.lit(max_df))
    idf = F.log((n + 1).cast("double") / (F.col("df") + 1)) + 1.0
    return per_term.withColumn("idf", idf).orderBy(F.desc("total"), "term").limit(max_features)


def fit(docs: DataFrame, text: str, max_features: int = 128, bigrams: bool = False,
        max_df: float = 1.0, stop_words: Sequence[str] | None = None) -> TextModel:
    """Fit the vocabulary. The default stop words are Spark's; they go before bigrams are formed.

    The model is held by the driver, like any fitted model: ``max_features``
    terms, however large the corpus.
    """
    words = tuple(default_stop_words() if stop_words is None else stop_words)
    return _fitted(count_terms(docs.select(text), text, words, bigrams), words, bigrams, max_features, max_df)


def _fitted(counted: DataFrame, words: tuple[str, ...], bigrams: bool, max_features: int,
            max_df: float) -> TextModel:
    rows = vocabulary(counted, max_features, max_df).collect()
    return TextModel({r["term"]: r["idf"] for r in rows}, words, bigrams)


def fit_weighed(docs: DataFrame, text: str, max_features: int = 128, bigrams: bool = False, max_df: float = 1.0,
                stop_words: Sequence[str] | None = None, columns: Sequence[str] | None = None
                ) -> tuple[DataFrame, TextModel]:
    """The documents with their ``weights``, and the model fitted on them; each text is tokenised once.

    Rows and term counts are stored in the shared folder between the two steps, and so are the
    weights: a lambda or a filter over them would else weigh the document again for every term.
    ``columns`` are those kept beside the weights, all unless given.
    """
    spark = docs.sparkSession
    words = tuple(default_stop_words() if stop_words is None else stop_words)
    counts, weights = (shared_folder(spark, label) for label in ("term-counts", "term-weights"))
    kept = docs.columns if columns is None else columns
    count_terms(docs, text, words, bigrams).select(*kept, "term_counts").write.parquet(counts)
    counted = spark.read.parquet(counts)
    model = _fitted(counted, words, bigrams, max_features, max_df)
    weigh_counted(counted, model).write.parquet(weights)
    return spark.read.parquet(weights), model


def weigh(docs: DataFrame, text: str, model: TextModel) -> DataFrame:
    """Adds ``weights``: a map from term to L2-normalised TF-IDF weight."""
    df = _with_tokens(docs, text, model.stop_words, model.bigrams)
    known = F.filter("_tokens", lambda t: t.isin(*model.idf))
    return weigh_counted(_with_counts(df.withColumn("_tokens", known)), model)


def weigh_counted(counted: DataFrame, model: TextModel) -> DataFrame:
    """Replaces ``term_counts`` by ``weights``; terms outside the vocabulary have none."""
    terms = list(model.idf)
    idf = F.map_from_arrays(F.array(*[F.lit(t) for t in terms]),
                            F.array(*[F.lit(model.idf[t]) for t in terms]))
    known = F.filter("term_counts", lambda c: c["term"].isin(*terms))
    raw = F.transform(known, lambda c: F.struct(
        c["term"].alias("term"), (c["n"] * F.element_at(idf, c["term"])).alias("w")))
    df = counted.withColumn("_raw", raw)
    length = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, c: acc + c["w"] * c["w"]))
    df = df.withColumn("_length", length)
    scaled = F.transform("_raw", lambda c: F.struct(
        c["term"].alias("term"),
        F.when(F.col("_length") > 0, c["w"] / F.col("_length")).alias("w")))
    return df.withColumn("weights", F.map_from_entries(scaled)).drop(
        "term_counts", "_raw", "_length")


def long_form(weighted: DataFrame, key: str) -> DataFrame:
    """One row per (document, term)."""
    return (weighted.select(key, F.explode_outer("weights").alias("term", "weight"))
            .filter(F.col("term").isNotNull()))


def dense(weighted: DataFrame, model: TextModel) -> DataFrame:
    """Adds ``vector``: the weights over the vocabulary in term order, zero where a term is absent.

    Documents weighed so can be clustered, projected and compared like any vectors.
    """
    terms = F.array(*[F.lit(t) for t in sorted(model.idf)])
    return weighted.withColumn("vector", F.transform(terms, lambda t: F.coalesce(
        F.try_element_at("weights", t), F.lit(0.0))))


def top_terms(weighted: DataFrame, k: int = 10) -> DataFrame:
    """Terms by mean weight over all documents."""
    n = weighted.agg(F.count("*")).scalar()
    return (weighted.select(F.explode_outer("weights").alias("term", "weight"))
            .filter(F.col("term").isNotNull()).groupBy("term")
            .agg((F.sum("weight") / n).alias("mean_weight"))
            .withColumn("mean_weight", F.round("mean_weight", SCORE_PLACES))
            .orderBy(F.desc("mean_weight"), "term").limit(k))


def project_queries(spark, queries: Mapping[str, str], model: TextModel) -> DataFrame:
    """Query texts on the fitted vocabulary: one row per query with its ``weights``."""
    rows = spark.createDataFrame(list(queries.items()), "query_id STRING, query STRING")
    return weigh(rows, "query", model)


def score(weighted: DataFrame, queries: Mapping[str, str], model: TextModel) -> DataFrame:
    """Every document with its cosine to every query.

    The queries are literal texts, weighed once in a scalar subquery; each
    document then multiplies its own weight map with theirs.
    """
    projected = project_queries(weighted.sparkSession, queries, model)
    packed = projected.agg(F.collect_list(F.struct(
        "query_id", F.map_entries("weights").alias("terms")))).scalar()
    paired = weighted.withColumn("_q", F.explode(packed))
    dot = F.aggregate("_q.terms", F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(
        F.try_element_at(F.col("weights"), e["key"]), F.lit(0.0)))
    return (paired.withColumn("query_id", F.col("_q.query_id"))
            .withColumn("similarity", F.round(dot, SCORE_PLACES)).drop("_q"))


def write_postings(weighted: DataFrame, key: str, path: str, champions: int = 64) -> None:
    """Store the weights as an inverted index: postings by term, heaviest first, and each term's champions.

    One exchange lays the postings out by term, band of weights and a slice of
    the documents, so a term that most documents hold spreads over many files,
    and the statistics that Parquet keeps per block say which terms and how
    large weights it holds. Champions are the ``champions`` heaviest postings
    of a term, a small table of its own.
    """
    long_form(weighted.select(key, "weights"), key).repartition(
        "term", F.floor(F.col("weight") * _BANDS), F.pmod(F.xxhash64(key), F.lit(_BANDS))).sortWithinPartitions(
        "term", F.desc("weight"), key).write.parquet(f"{path}/postings")
    postings = weighted.sparkSession.read.parquet(f"{path}/postings")
    top_n_per_group(postings, ["term"], [F.desc("weight"), F.asc(key)], champions, F.col(key)).write.parquet(
        f"{path}/champions")


def _floors(champions, parts: Mapping[str, Mapping[str, float]], key: str, k: int) -> dict[str, float]:
    """For each query a score that its ``k`` best reach at least, from the champions of its terms alone."""
    floors = {}
    for query, weights in parts.items():
        sums: dict = {}
        for row in champions:
            if row["term"] in weights:
                sums[row[key]] = sums.get(row[key], 0.0) + weights[row["term"]] * row["weight"]
        best = sorted(sums.values(), reverse=True)
        floors[query] = max(0.0, best[k - 1] - 1e-8) if len(best) >= k else 0.0
    return floors


def search_postings(keys: DataFrame, key: str, path: str, queries: Mapping[str, str], model: TextModel,
                    k: int = 3) -> DataFrame:
    """The ``k`` most similar documents per query from an index: query_id, key, similarity, rank.

    Only postings of the queries' terms are read. A document that reaches the
    floor that the champions set must get an even share of it from one of the
    query's terms at least, so only documents with one such heavy posting are
    summed up; the weight is tested where Parquet is read. Nothing is
    approximate. Documents that share no term with a query follow by key.
    """
    spark = keys.sparkSession
    parts: dict[str, dict[str, float]] = {q: {} for q in queries}
    for row in long_form(project_queries(spark, queries, model), "query_id").collect():
        parts[row["query_id"]][row["term"]] = row["weight"]
    terms = sorted({t for weights in parts.values() for t in weights})
    postings = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(*terms))
    floors = _floors(spark.read.parquet(f"{path}/champions").where(F.col("term").isin(*terms)).collect(), parts, key, k)
    asked = [(q, t, w, floors[q] / (len(weights) * w)) for q, weights in parts.items() for t, w in weights.items()]
    wanted = spark.createDataFrame(asked, "query_id STRING, term STRING, _share DOUBLE, _least DOUBLE")
    lowest = {t: min(least for _, u, _, least in asked if u == t) for t in terms}
    heavy = reduce(or_, [(F.col("term") == t) & (F.col("weight") >= least) for t, least in lowest.items()], F.lit(False))
    likely = postings.where(heavy).join(wanted, "term").where(F.col("weight") >= F.col("_least")).select(
        "query_id", key).distinct()
    scored = postings.join(wanted, "term").join(likely, ["query_id", key], "left_semi").groupBy("query_id", key).agg(
        F.round(F.sum(F.col("weight") * F.col("_share")), SCORE_PLACES).alias("similarity"))
    first = keys.select(key).orderBy(key).limit(2 * k)  # enough, since they count only where fewer than k share a term
    others = first.select(F.explode(F.array(*map(F.lit, queries))).alias("query_id"), key).join(
        scored, ["query_id", key], "left_anti").withColumn("similarity", F.lit(0.0))
    return top_n_per_group(scored.unionByName(others), ["query_id"],
                           [F.desc("similarity"), F.asc(key)], k, F.col(key))


def search(weighted: DataFrame, key: str, queries: Mapping[str, str], model: TextModel,
           k: int = 3, columns: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most similar documents per query, by cosine, then key, over an index written for it.

    Only keys and scores are sorted; ``columns`` of the few hits are joined back after.
    """
    path = shared_folder(weighted.sparkSession, "postings")
    write_postings(weighted, key, path)
    hits = search_postings(weighted.select(key), key, path, queries, model, k)
    return hits.join(weighted.select(key, *columns), key) if columns else hits


def recommend(weighted: DataFrame, key: str, text: str, query: str, model: TextModel,
              k: int = 3) -> DataFrame:
    """The ``k`` most similar documents whose text is not the query itself."""
    others = weighted.filter(F.lower(text) != query.lower())
    return search(others, key, {"query": query}, model, k, [text])


def recommend_for_profile(weighted: DataFrame, key: str, interests: Sequence[str],
                          model: TextModel, max_complexity: int, domains: Sequence[str],
                          per_interest: int = 2, k: int = 10) -> DataFrame:
    """Best hits per interest, within complexity and domains, each item once, with a reason."""
    hits = search(weighted, key, {i: i for i in interests}, model, 3,
                  ["complexity", "domain"]).filter(F.col("rank") <= per_interest)
    kept = hits.filter((F.col("complexity") <= max_complexity) & F.col("domain").isin(*domains))
    order = [F.desc("similarity"), F.asc(key), F.asc("query_id")]
    return best_per_id(kept, key, order, k, F.col(key)).withColumn(
        "reason", F.concat(F.lit("Based on interest: "), F.col("query_id")))


def vector_classes(weighted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents of equal weights as one class: (class_id, size, entries) and the membership (key, class_id).

    ``class_id`` is the smallest key of the class. Documents without a weight belong to none.
    """
    marked = weighted.where(F.size("weights") > 0).select(F.col(key), F.array_sort(F.transform(
        F.map_entries("weights"), lambda e: F.struct(e["key"].alias("term"), F.round(e["value"], SCORE_PLACES).alias("w"))
    )).alias("entries"))
    classes = marked.groupBy("entries").agg(F.min(key).alias("class_id"), F.count("*").alias("size"))
    members = marked.join(classes, "entries").select(key, "class_id")
    return classes, members


def rarest_first(model: TextModel) -> list[str]:
    """The vocabulary in the order of rarity, ties by term; the idf falls as the document count grows."""
    return sorted(model.idf, key=lambda t: (-model.idf[t], t))


def line_of_weights(order: Sequence[str]) -> Column:
    """A class's ``entries`` as one weight per term of ``order``; a map is searched entry by entry, a line is not.

    Terms and weights are taken out of the entries once, as the one element of an outer array, not for every term.
    """
    parts = F.struct(F.col("entries.term").alias("term"), F.col("entries.w").alias("w"))
    return F.get(F.transform(F.array(parts), lambda e: F.transform(F.array(*map(F.lit, order)), lambda t: F.coalesce(
        F.get(e["w"], (F.array_position(e["term"], t) - 1).cast("int")), F.lit(0.0)))), F.lit(0))


def similar_classes(classes: DataFrame, model: TextModel, threshold: float = 0.8) -> DataFrame:
    """Pairs of classes whose cosine reaches ``threshold``: class_a, class_b, size_a, size_b, similarity."""
    return likely_pairs(classes, model, threshold).where(F.col("similarity") >= threshold)


def likely_pairs(classes: DataFrame, model: TextModel, threshold: float) -> DataFrame:
    """All pairs of classes whose cosine reaches ``threshold``, perhaps with others that were scored to tell.

    Terms are put in the order of their rarity. Two unit vectors of cosine t are
    sqrt(2 - 2t) apart, so no weight differs by more. Where that width is small,
    classes are joined by cells of it (``_pairs_by_cells``), else by prefixes
    (``_pairs_by_prefix``). Nothing is missed.
    """
    order = rarest_first(model)
    places = F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*[F.lit(i) for i in range(len(order))]))
    ranked = classes.where(F.col("class_id").isNotNull()).withColumn("ranked", F.array_sort(F.transform(
        "entries", lambda e: F.struct(F.element_at(places, e["term"]).alias("at"), e["w"].alias("w")))))
    # the weights' nine places move a length by 1e-8 at most, the similarity's eight places a cosine by 5e-9
    width = math.sqrt(max(2 * (1 - threshold), 0) + 1e-7) + 1e-6
    return _pairs_by_cells(ranked, order, width) if width < 0.1 else _pairs_by_prefix(ranked, len(order), threshold)


def _pairs_by_prefix(ranked: DataFrame, terms: int, threshold: float) -> DataFrame:
    """The pairs that reach ``threshold``, by a prefix-filter join.

    A class's prefix ends where the rest of its vector is shorter than the
    threshold, so two classes that reach it share a term of both prefixes. The
    classes under a term are dealt into slices of about ``_SLICE``, and every two
    slices meet in a group of their own, which scores them as matrices and
    passes on the pairs that reach the threshold and share no rarer term.
    """
    def longer(seen, e):  # from the end: a term belongs to the prefix if the vector from it on is long enough
        square = seen["square"] + e["w"] * e["w"]
        return F.struct(square.alias("square"), F.when(
            square >= (threshold - 1e-6) ** 2, F.array_append(seen["kept"], e["at"])).otherwise(seen["kept"]).alias("kept"))

    prefix = F.aggregate(F.reverse("ranked"), F.struct(F.lit(0.0).alias("square"), F.array().cast("array<int>").alias("kept")),
                         longer, lambda seen: seen["kept"])
    path = shared_folder(ranked.sparkSession, "prefixes")
    ranked.select("class_id", "size", F.col("ranked.at").alias("terms"), F.col("ranked.w").alias("weights"),
                  prefix.alias("prefix")).write.parquet(path)
    listed = ranked.sparkSession.read.parquet(path).select("class_id", "size", "terms", "weights", F.explode("prefix").alias("at"))
    slices = [0] * terms
    for r in listed.groupBy("at").count().collect():
        slices[r["at"]] = math.ceil(r["count"] / _SLICE)
    n = F.get(F.array(*map(F.lit, slices)), F.col("at")) if terms else F.lit(0)
    own = listed.withColumn("_n", n).withColumn("slice", F.pmod(F.xxhash64("class_id"), "_n").cast("int"))
    met = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        "at", F.least("slice", "_other").alias("low"), F.greatest("slice", "_other").alias("high"), "slice",
        "class_id", "size", "terms", "weights")
    key = ranked.schema["class_id"].dataType.simpleString()
    return met.groupBy("at", "low", "high").applyInArrow(
        kernels.pairs_of_slices(terms, threshold, SCORE_PLACES - 1),
        f"class_a {key}, class_b {key}, size_a long, size_b long, similarity double")


def _pairs_by_cells(ranked: DataFrame, order: Sequence[str], width: float) -> DataFrame:
    """Pairs of classes in cells beside each other, among them all that are at most ``width`` apart.

    Prefixes are the terms within two widths of the heaviest (one's heaviest term
    is such a term of the other). Terms are joined by cells as well, of this width
    in the term's weight and along one fixed direction, each with those beside
    it. A pair is met under its first shared prefix term alone, and scored in full.
    """
    line = F.col("weights") if "weights" in ranked.columns else line_of_weights(order)
    cut = ranked.select("class_id", "size", line.alias("weights"), "ranked").withColumn(
        "_top", F.array_max("weights")).withColumn("prefix", F.transform(F.filter(
            "ranked", lambda e: (F.col("_top") > 0) & (e["w"] >= F.col("_top") - 2 * width)), lambda e: e["at"]))
    across = np.random.default_rng(7).normal(size=len(order))
    along = F.aggregate(F.zip_with("weights", F.array(*[F.lit(float(x)) for x in across / np.linalg.norm(across)]),
                                   lambda w, x: w * x), F.lit(0.0), lambda total, x: total + x)
    listed = cut.select("class_id", "size", "weights", "prefix", F.explode("prefix").alias("at")).withColumn(
        "cell", F.floor(F.get("weights", F.col("at")) / width)).withColumn("band", F.floor(along / width))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    beside = listed.withColumn("_by", F.explode(shifts)).withColumn("cell", F.col("cell") + F.col("_by.i")).withColumn(
        "band", F.col("band") + F.col("_by.j"))
    a, b = (side.select("at", "cell", "band", *[F.col(c).alias(f"{c}_{name}") for c in ("class_id", "size", "weights", "prefix")])
            for side, name in ((beside, "a"), (listed, "b")))
    met = a.join(b, ["at", "cell", "band"]).where((F.col("class_id_a") < F.col("class_id_b")) & (
        F.array_min(F.array_intersect("prefix_a", "prefix_b")) == F.col("at")))
    dot = F.aggregate(F.zip_with("weights_a", "weights_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return met.select(F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b"), "size_a", "size_b",
                      F.round(dot, SCORE_PLACES - 1).alias("similarity"))


def match_profile(hits: DataFrame, means: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Means and value counts of the matches, in long form, from one pass."""
    cell = lambda field, value, amount: F.struct(
        field.alias("field"), value.cast("string").alias("value"),
        amount.cast("double").alias("amount"))
    cells = [cell(F.lit(f"avg_{m}"), F.lit(""), F.col(m)) for m in means]
    cells += [cell(F.lit(c), F.col(c), F.lit(1)) for c in counts]
    mean_fields = [f"avg_{m}" for m in means]
    return hits.select(F.inline(F.array(*cells))).groupBy("field", "value").agg(
        F.when(F.col("field").isin(*mean_fields), F.avg("amount")).otherwise(F.sum("amount"))
        .alias("amount"))


def hybrid_search(hits: DataFrame, keyword_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Vector hits, keyword matches and file names as one labelled result."""
    return (hits.select(F.lit("vector").alias("source"), F.col("ref"), "score")
            .unionByName(keyword_rows.select(F.lit("keyword").alias("source"), "ref",
                                             F.lit(None).cast("double").alias("score")))
            .unionByName(files.select(F.lit("file").alias("source"), "ref",
                                      F.lit(None).cast("double").alias("score"))))
