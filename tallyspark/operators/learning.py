"""The text model behind the rules: character n-grams, TF-IDF and calibrated multinomial logistic regressions of Spark ML.

N-grams are those of 3 to 5 characters within words that have a blank at either side. Frequencies count as 1 + ln tf,
documents as ln((1 + n) / (1 + df)) + 1; vectors have length 1; classes weigh the same.

Probabilities are calibrated: rows fall into FOLDS parts by a hash, equal rows into different ones; for each part a regression is trained on the others,
and on the part itself a sigmoid of each class's margin, with targets smoothed by the number of rows. A text's
probabilities are the sigmoids', made to sum to 1, averaged over the parts.

Training needs at least 20 rows and 2 categories; the user's rows count three times. Null descriptions count as empty. A
category that a part's training rows lack is only known to the other parts.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyspark.functions import constants as K
from tallyspark.functions import scalars as S
from tallyspark.operators import ledger as L

FEATURES, STRENGTH, LEAST_ROWS, LEAST_CATEGORIES, USER_TIMES, FOLDS = 50_000, 10.0, 20, 2, 3, 3
COLUMNS = ["description", "direction", "category", "source"]


def n_grams(text):
    """The n-grams of a text's words; a word shorter than n is one n-gram, counted once."""
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(word, n):
        short = F.when((F.length(word) == n) | F.lit(n == 3), F.array(word)).otherwise(F.array().cast("array<string>"))
        return F.when(F.length(word) <= n, short).otherwise(F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n))))

    return F.flatten(F.transform(words, lambda w: F.concat(*[grams(w, n) for n in (3, 4, 5)])))


def with_terms(rows: DataFrame) -> DataFrame:
    """terms: the n-grams of description and direction."""
    return rows.withColumn("terms", n_grams(S.featurise(F.col("description"), F.col("direction"))))


def weighted(rows: DataFrame, idf: np.ndarray | None) -> DataFrame:
    """rows with features: the counts tf as 1 + ln tf, times the weights of terms (at most FEATURES numbers) if given, as
    vectors of length 1. The values of a batch's sparse vectors are one array."""
    at = rows.columns.index("tf")
    schema = T.StructType([*rows.schema.fields, T.StructField("features", VectorUDT())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            tf = batch.column(at)
            indices, values = tf.field("indices"), tf.field("values")
            x = 1 + np.log(values.flatten().to_numpy(zero_copy_only=False))
            if idf is not None:
                x = x * idf[indices.flatten().to_numpy(zero_copy_only=False)]
            size = values.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(size)), size)
            norm = np.sqrt(np.bincount(owner, x * x, minlength=len(size)))
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            made = pa.ListArray.from_arrays(offsets, pa.array(x / np.where(norm > 0, norm, 1)[owner]))
            features = pa.StructArray.from_arrays([tf.field("type"), tf.field("size"), indices, made], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), features.cast(arrow.field("features").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


@dataclass
class TextModel:
    """Vocabulary, weights of terms, categories, and for each part a regression and its sigmoids (slope, shift) by class."""

    terms: CountVectorizerModel
    idf: np.ndarray
    labels: list[str]
    parts: list[LogisticRegressionModel]
    sigmoids: list[list[tuple[float, float]]]

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """rows (terms, ...) with probability, an array by label."""
        kept = rows.columns
        found = weighted(self.terms.transform(rows), self.idf)
        shares = []
        for i, (part, own) in enumerate(zip(self.parts, self.sigmoids)):
            found = part.transform(found).withColumn(f"_m{i}", vector_to_array("rawPrediction")).drop("rawPrediction", "probability", "prediction")
            shares.append(sigmoid_shares(F.col(f"_m{i}"), own))
        mean = F.transform(F.arrays_zip(*[x.alias(f"p{i}") for i, x in enumerate(shares)]), lambda z: sum((z[f"p{i}"] for i in range(len(shares))), F.lit(0.0)) / len(shares))
        return found.select(*kept, mean.alias("probability"))


def sigmoid_shares(margins: Column, sigmoids: list[tuple[float, float]]) -> Column:
    """The classes' sigmoids of an array of margins, made to sum to 1; the same for all if all are 0."""
    known = F.lit([[float(a), float(b)] for a, b in sigmoids])
    p = F.zip_with(margins, known, lambda m, s: 1 / (1 + F.exp(-(s[0] * m + s[1]))))

    def shares(xs: Column) -> Column:
        total = F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
        return F.transform(xs, lambda x: F.when(total > 0, x / total).otherwise(1 / len(sigmoids)))

    return S.let(p, shares)


def fit_sigmoids(margins: DataFrame, classes: int, rounds: int = 25) -> list[list[tuple[float, float]]]:
    """Slope and shift by part and class, from rows (part, label, margins): Newton's method on the log loss of smoothed
    targets. A round is one aggregate over all parts and classes; only their sums come to the driver."""
    n = FOLDS * classes
    flat = margins.select("part", F.posexplode("margins").alias("c", "m"), "label").select((F.col("part") * classes + F.col("c")).alias("k"), "m", (F.col("c") == F.col("label")).cast("double").alias("y")).persist()
    seen = {r["k"]: (r["pos"], r["n"] - r["pos"]) for r in flat.groupBy("k").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()}
    by_class = lambda values: F.get(F.lit([float(v) for v in values]), F.col("k"))
    pos, neg = ([seen.get(k, (0, 0))[i] for k in range(n)] for i in (0, 1))
    target = F.when(F.col("y") == 1, by_class([(x + 1) / (x + 2) for x in pos])).otherwise(by_class([1 / (x + 2) for x in neg]))
    at = np.array([(0.0, math.log((x + 1) / (y + 1))) for x, y in zip(pos, neg)])
    best, step, least = at.copy(), np.zeros((n, 2)), np.full(n, np.inf)
    for _ in range(rounds if seen else 0):
        z, p = F.col("z"), 1 / (1 + F.exp(-F.col("z")))
        rows = flat.select("k", "m", target.alias("t"), (by_class(at[:, 0]) * F.col("m") + by_class(at[:, 1])).alias("z"))
        loss = F.greatest(z, F.lit(0.0)) - F.col("t") * z + F.log1p(F.exp(-F.abs(z)))
        e, w = p - F.col("t"), p * (1 - p)
        sums = rows.groupBy("k").agg(*[F.sum(x) for x in (loss, e * F.col("m"), e, w * F.col("m") ** 2, w * F.col("m"), w)]).collect()
        for k, loss, ga, gb, aa, ab, bb in sums:
            if loss <= least[k]:
                aa, bb = aa + 1e-9, bb + 1e-9
                det = aa * bb - ab * ab or 1e-9
                least[k], best[k], step[k] = loss, at[k], ((bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det)
            else:  # too far: half of the step
                step[k] /= 2
        at = best - step
        if np.abs(step).max() < 1e-5:
            break
    flat.unpersist()
    best[[k not in seen for k in range(n)]] = (0.0, -20.0)  # a class that a part knows nothing of
    return [[(float(x), float(y)) for x, y in own] for own in best.reshape(FOLDS, classes, 2)]


def merge_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new label rows (COLUMNS); of equal description, direction and category the last one stays."""
    missing = {"description", "direction", "category"} - set(new.columns)
    if missing:
        raise ValueError(f"label rows lack {sorted(missing)}")
    numbered = old.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)), allowMissingColumns=True).withColumn("_at", F.struct("_part", F.monotonically_increasing_id()))
    return L.keep_last(numbered.drop("_part"), "_at").drop("_at")


def train(labels: DataFrame) -> TextModel | None:
    """A model of label rows (COLUMNS), or None if there are too few."""
    size = labels.agg(F.count("*").alias("n"), F.count_distinct("category").alias("k")).first()
    if size["n"] < LEAST_ROWS or size["k"] < LEAST_CATEGORIES:
        return None
    names = sorted(r[0] for r in labels.where("category is not null").select("category").distinct().collect())
    rows = L.replicate_user_rows(labels.where("category is not null"), USER_TIMES)
    # merge_feedback() leaves USER_TIMES equal rows at most
    same = F.row_number().over(Window.partitionBy("category", "description", "direction").orderBy("copy"))
    part = F.pmod(F.pmod(F.xxhash64("category", "description", "direction"), F.lit(FOLDS)) + same, F.lit(FOLDS)).cast("int")
    rows = rows.withColumn("label", (F.array_position(F.lit(names), F.col("category")) - 1).cast("double")).withColumn("part", part)
    # so many partitions as rows ask for: each step of each regression is a job over them
    rows = with_terms(rows).select("label", "part", "terms").repartition(-(-size["n"] // 5000)).persist()
    terms = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=FEATURES).fit(rows)
    counted = terms.transform(rows)
    idf = np.asarray(IDF(inputCol="tf", outputCol="tfidf").fit(counted).idf.toArray()) + 1
    counts, rows = rows, weighted(counted, idf).select("label", "part", "features").persist()
    parts, margins = [], None
    for p in range(FOLDS):
        own = rows.where(F.col("part") != p)
        sizes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
        total = sum(sizes.values())
        if len(sizes) < LEAST_CATEGORIES:
            rows.unpersist(), counts.unpersist()
            return None
        # a row for each category, as an expression
        weight = F.element_at(F.create_map(*[F.lit(x) for y, m in sizes.items() for x in (y, total / (len(sizes) * m))]), F.col("label"))
        fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=1 / (STRENGTH * total), standardization=False, maxIter=100).fit(own.withColumn("weight", weight))
        known = fitted.numClasses
        held = fitted.transform(rows.where(F.col("part") == p)).select("part", F.col("label").cast("int").alias("label"), vector_to_array("rawPrediction").alias("margins"))
        margins = held if margins is None else margins.unionByName(held)
        parts.append(fitted)
        if known < len(names):  # the last categories are missing here
            pad = F.array_repeat(F.lit(-1e3), len(names) - known)
            margins = margins.withColumn("margins", F.when(F.size("margins") < len(names), F.concat("margins", pad)).otherwise(F.col("margins")))
    sigmoids = fit_sigmoids(margins, len(names))
    rows.unpersist(), counts.unpersist()
    return TextModel(terms, idf, names, parts, [own[: m.numClasses] + [(0.0, -20.0)] * (len(names) - m.numClasses) for own, m in zip(sigmoids, parts)])


def classify(rows: DataFrame, model: TextModel | None, least: float = K.MIN_CONFIDENCE) -> DataFrame:
    """category, confidence and method of a ledger: rules first, the model only for what no rule matches."""
    by_rule = L.classify(rows)
    if model is None:
        return by_rule
    rest = model.probabilities(with_terms(by_rule.where("method = 'default'").withColumn("direction", S.direction(F.col("debit")))))
    top = F.array_max("probability")
    guess = F.element_at(F.lit(model.labels), F.array_position("probability", top).cast("int"))
    guessed = L.gate(rest.withColumns({"guess": guess, "probability": top}), least)
    return by_rule.where("method <> 'default'").unionByName(guessed.select(*by_rule.columns))


def learn(spark: SparkSession, new: DataFrame, feedback_path: str, seed: DataFrame | None = None) -> tuple[TextModel | None, int]:
    """Adds rows to the feedback table and trains on it, and on seed rows if given; returns the model and the number of rows."""
    from tallyspark.sources import labels as source

    merged = merge_feedback(source.read_feedback(spark, feedback_path), new)
    source.replace_feedback(merged.select(*COLUMNS), feedback_path)
    rows = source.read_feedback(spark, feedback_path)
    if seed is not None:
        rows = rows.unionByName(seed.select(*COLUMNS))
    return train(rows), rows.count()


def bootstrap(spark: SparkSession, path: str, seed_path: str) -> TextModel | None:
    """The saved model; if there is none, one of the seed file's rows, which is saved."""
    from tallyspark.sources import labels as source

    model = load(spark, path)
    if model is None and (model := train(source.read_seed(spark, seed_path))) is not None:
        save(spark, model, path)
    return model


def save(spark: SparkSession, model: TextModel, path: str) -> None:
    """The parts of a model below path; a model counts as saved when its last part, the table of numbers, is."""
    model.terms.write().overwrite().save(f"{path}/terms")
    for i, part in enumerate(model.parts):
        part.write().overwrite().save(f"{path}/part{i}")
    numbers = json.dumps({"idf": model.idf.tolist(), "labels": model.labels, "sigmoids": model.sigmoids})
    spark.createDataFrame([(numbers,)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")


def load(spark: SparkSession, path: str) -> TextModel | None:
    """The saved model, or None if there is none that can be read."""
    try:
        numbers = json.loads(spark.read.parquet(f"{path}/numbers").first()[0])
        parts = [LogisticRegressionModel.load(f"{path}/part{i}") for i in range(FOLDS)]
        return TextModel(CountVectorizerModel.load(f"{path}/terms"), np.array(numbers["idf"]), numbers["labels"], parts, [[tuple(s) for s in own] for own in numbers["sigmoids"]])
    except Exception as error:  # any unreadable model is as good as none
        import logging

        logging.getLogger(__name__).warning("no model read from %s: %s", path, error)
        return None
