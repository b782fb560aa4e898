"""Detectors over feature tables: floors, gradient-boosted trees, logistic regression."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import chance


def random_score(seed: int, row_id: Column) -> Column:
    """A number in [0, 1) from the hash of seed and row id."""
    return F.conv(F.substring(chance(seed, row_id), 1, 12), 16, 10).cast("double") / float(16**12)


def random_scores(rows: DataFrame, seed: int) -> DataFrame:
    return rows.select("row_id", random_score(seed, F.col("row_id")).alias("score"))


def prevalence_scores(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """The training rate of positives for every row."""
    return test.select("row_id").crossJoin(F.broadcast(train.agg(F.avg(F.col(label).cast("double")).alias("score"))))  # one row


def comparable(rows: DataFrame, column: str) -> Column:
    """A column as a key of equal rows: floats at six digits."""
    return F.rint(F.col(column) * 1e6) if dict(rows.dtypes)[column] in ("double", "float") else F.col(column)


def memory_scores(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """The rate of positives among training rows of equal features (nulls are equal), else among all: what remembering alone is worth.

    Training rows are one row a pattern before they meet the test rows; 0 where nothing was trained on.
    """
    y, keys = F.col(label).cast("double"), [f"_k{i}" for i in range(len(features))]
    keyed = lambda df, *more: df.select(*more, *[comparable(df, c).alias(k) for c, k in zip(features, keys, strict=True)])
    known = keyed(train, y.alias("_y")).groupBy(*keys).agg(F.avg("_y").alias("_rate"))
    known = known.select("_rate", *[F.col(k).alias(f"_of{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys]
    met = keyed(test, "row_id").join(known, same, "left") if keys else test.select("row_id", F.lit(None).cast("double").alias("_rate"))
    overall = train.agg(F.avg(y).alias("_all"))
    return met.crossJoin(F.broadcast(overall)).select("row_id", F.coalesce("_rate", "_all", F.lit(0.0)).alias("score"))  # one row


def _scored(model, test: DataFrame) -> DataFrame:
    return model.transform(test).select("row_id", vector_to_array("probability")[1].alias("score"))


def boosted_trees(train: DataFrame, test: DataFrame, features: list[str], label: str, trees: int = 20, seed: int = 0) -> DataFrame:
    """Scores of gradient-boosted trees on raw features (nulls count as 0).

    Training rows of equal features and label are one row with their number as its
    weight: the sums that choose a split are the same, and a fit costs what its
    patterns do.
    """
    assembler, filled = VectorAssembler(inputCols=features, outputCol="features"), lambda df: df.fillna(0, features)
    known = filled(train).groupBy(*features, F.col(label).cast("double").alias("label")).agg(F.count("*").cast("double").alias("_w"))
    model = GBTClassifier(maxIter=trees, maxDepth=4, seed=seed, weightCol="_w").fit(assembler.transform(known))
    return _scored(model, assembler.transform(filled(test).select("row_id", *features)))


def logistic(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """Scores of a balanced logistic regression on log1p features standardised on the training rows."""
    logged = lambda df: df.select("row_id", *([F.col(label).cast("double").alias("label")] if label in df.columns else []), *[F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0.0))).alias(c) for c in features])
    fit = logged(train)
    positive = fit.agg(F.avg("label").alias("p")).first().p or 0.5
    weight = F.when(F.col("label") == 1, 0.5 / max(positive, 1e-9)).otherwise(0.5 / max(1 - positive, 1e-9))
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    model = LogisticRegression(weightCol="w", regParam=1e-3, standardization=True).fit(assembler.transform(fit.withColumn("w", weight)))
    return _scored(model, assembler.transform(logged(test)))


#: Detectors by name: each takes training rows, test rows, features and the label.
REGISTRY = {
    "boosted_trees": lambda train, test, features, label, seed=0: boosted_trees(train, test, features, label, seed=seed),
    "logistic": lambda train, test, features, label, seed=0: logistic(train, test, features, label),
    "majority": lambda train, test, features, label, seed=0: prevalence_scores(train, test, label),
    "random": lambda train, test, features, label, seed=0: random_scores(test, seed),
    "memory": lambda train, test, features, label, seed=0: memory_scores(train, test, features, label),
}


def detector(name: str):
    """The detector of a name; ``KeyError`` lists the names there are."""
    if name not in REGISTRY:
        raise KeyError(f"{name!r} is no detector: one of {', '.join(REGISTRY)}")
    return REGISTRY[name]
