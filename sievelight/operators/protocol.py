"""The protocol around splits: settings, folds, checks of a split, merged certificates, metrics by fold."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import staged
from . import curves, leakage
from .detectors import random_score

#: Below so many positives no rate is reported.
LEAST_SUPPORT = 20
MODES = ("replica", "random", "chronological", "loro")
#: Rows up to which a forest samples single rows; above it, equal rows go in blocks.
BLOCKS = 100_000
#: Severities from best to worst.
SEVERITIES = ("ok", "warn", "fail")
#: Minutes of a day, the number of windows that a host has in it.
WINDOWS_PER_DAY = 1440


# Settings


#: Which settings name replicas, how many at least, and the bounds of numbers, by kind of split.
NAMING = {"replica": {"train": 1, "test": 1}, "random": {"replicas": 1}, "chronological": {"replicas": 1}, "loro": {"replicas": 2}}
SHARES = {"train_pct": (20, 100), "val_pct": (0, 100), "test_pct": (5, 100)}
BOUNDS = {"replica": {"val_fraction": (0.05, 0.4)}, "loro": {"val_fraction": (0.05, 0.4)}, "random": SHARES, "chronological": SHARES}
DEFAULTS = {"val_fraction": 0.15, "seed": 0}
SEEDED = ("replica", "random", "loro")


def _finite(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and -float("inf") < x < float("inf")


def config_errors(config: dict, replicas: list[str]) -> list[str]:
    """The settings that a split cannot be made with, each as ``setting: reason``; none if all are right."""
    kind = config.get("mode") if isinstance(config, dict) else None
    if kind not in MODES:
        return [f"mode: {kind!r}, not {'/'.join(MODES)}"]
    held = DEFAULTS | config
    wrong: list[tuple[str, str]] = []
    named: dict[str, set] = {}
    for setting, least in NAMING[kind].items():
        names = list(held[setting]) if isinstance(held.get(setting), (list, tuple)) else []
        named[setting] = set(names)
        if len(names) < least:
            wrong.append((setting, f"{len(names)} of {least} or more replicas"))
        counts = {n: names.count(n) for n in names}
        wrong += [(setting, f"{n!r} unknown") for n in counts if n not in replicas]
        wrong += [(setting, f"{n!r} {k} times") for n, k in counts.items() if k > 1]
    wrong += [("train/test", f"{n!r} shared") for n in sorted(named.get("train", set()) & named.get("test", set()))]
    numbers = {setting: held.get(setting) for setting in BOUNDS[kind]}
    for setting, x in numbers.items():
        low, high = BOUNDS[kind][setting]
        if not _finite(x):
            wrong.append((setting, f"{x!r} is not a number"))
        elif not low <= x <= high:
            wrong.append((setting, f"{x:g}, not {low:g} to {high:g}"))
    if BOUNDS[kind] is SHARES and all(map(_finite, numbers.values())) and abs(sum(numbers.values()) - 100) > 1e-9:
        wrong.append(("/".join(numbers), f"sum {sum(numbers.values()):g}, not 100"))
    if kind in SEEDED and not isinstance(held["seed"], int):
        wrong.append(("seed", f"{held['seed']!r} is not whole"))
    return [f"{setting}: {reason}" for setting, reason in wrong]


def loro_folds(config: dict, replicas: list[str]) -> list[dict]:
    """One replica split for each chosen replica, trained on the others, in the order of the replicas."""
    if errors := config_errors(config, replicas):
        raise ValueError("; ".join(errors))
    chosen = [r for r in replicas if r in set(config["replicas"])]
    return [{"mode": "replica", "train": [r for r in chosen if r != out], "test": [out], "val_fraction": config.get("val_fraction", 0.15), "seed": config.get("seed", 0)} for out in chosen]


def replica_part(row_id: Column, replica: Column, config: dict, replicas: list[str]) -> Column:
    """The part of a row: whole replicas to either side, and by chance an expected share of the training rows for validation.

    Chance is the place of a row's hash in its range, so no rows are gathered to be ranked.
    """
    if errors := config_errors(config, replicas):
        raise ValueError("; ".join(errors))
    part = F.when(replica.isin(config["test"]), "test").when(~F.coalesce(replica.isin(config["train"]), F.lit(False)), "unused")
    return part.when(random_score(config.get("seed", 0), row_id) < config.get("val_fraction", 0.15), "val").otherwise("train")


# Checks of a split


def severity(count: Column, total: Column, fail_above: float = 0.0) -> Column:
    """``ok`` for none, ``fail`` for more than a share, ``warn`` between."""
    return F.when(count == 0, "ok").when(count > fail_above * total, "fail").otherwise("warn")


def split_checks(rows: DataFrame, replica: str, stretch: list[str], features: list[str], quiet: Column, y: str) -> DataFrame:
    """``check_name, n, of, severity`` of rows with ``part``: replicas and stretches on both sides, test rows that repeat a training row (quiet, active), support.

    A stretch on both sides fails; active repeats fail above one test row in a
    hundred; quiet ones only warn; fewer than ``LEAST_SUPPORT`` positives warn.
    Each check aggregates its key first, so no pair of rows is made.
    """
    is_train, is_test = F.col("part") == "train", F.col("part") == "test"
    sides = lambda keys, frame=rows: frame.groupBy(*keys).agg(F.max(is_train).alias("_a"), F.max(is_test).alias("_b"), F.count_if(is_test).alias("_n"))
    shared = lambda keys, name: sides(keys).agg(F.count_if(F.col("_a") & F.col("_b")).alias("n"), F.count_if("_b").alias("of")).select(F.lit(name).alias("check_name"), "n", "of")
    marked = rows.withColumn("_quiet", quiet)
    repeats = sides([*features, "_quiet"], marked).groupBy().agg(
        *[F.coalesce(F.sum(F.when((F.col("_quiet") == q) & F.col("_a"), F.col("_n"))), F.lit(0)).alias(name) for q, name in ((True, "quiet"), (False, "active"))], F.coalesce(F.sum("_n"), F.lit(0)).alias("of")
    )
    support = rows.agg(F.count_if(is_test & (F.col(y) == 1)).alias("n"), F.count_if(is_test).alias("of"))
    found = shared([replica], "replica").unionByName(shared(stretch, "stretch"))
    found = found.unionByName(repeats.select(F.lit("quiet_repeats").alias("check_name"), F.col("quiet").alias("n"), "of")).unionByName(repeats.select(F.lit("active_repeats").alias("check_name"), F.col("active").alias("n"), "of"))
    found = found.unionByName(support.select(F.lit("support").alias("check_name"), "n", "of"))
    judged = F.when(F.col("check_name") == "support", F.when(F.col("n") < LEAST_SUPPORT, "warn").otherwise("ok")).when(F.col("check_name") == "quiet_repeats", F.when(F.col("n") > 0, "warn").otherwise("ok"))
    return found.withColumn("severity", judged.when(F.col("check_name") == "active_repeats", severity(F.col("n"), F.col("of"), 0.01)).otherwise(severity(F.col("n"), F.col("of"))))


def merged_checks(checks: DataFrame) -> DataFrame:
    """Checks ``fold, check_name, n, of, severity`` of several folds as one: summed counts, the worst severity, the folds flagged in order."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    flagged = F.array_sort(F.collect_list(F.when(F.col("severity") != "ok", F.col("fold").cast("string"))))  # a row per fold
    worst = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(rank).cast("int"))
    return checks.groupBy("check_name").agg(F.sum("n").alias("n"), F.sum("of").alias("of"), worst.alias("severity"), F.array_join(flagged, ",").alias("flagged"), (F.max(rank) < 3).alias("passes"))


def _counted(rows: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """Rows of equal features and keys as one, with their number ``n``; in an order, so that fits can be repeated."""
    by = [*keys, *features]
    return staged(rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by), "counted-rows")


def _cross_scores(counted: DataFrame, features: list[str], folds: int, seed: int, trees: int) -> DataFrame:
    """``label, p`` (array by class) ``, n`` of all rows, from a forest that has not seen the rows' fold.

    ``counted`` has the features, ``_fold``, ``_y`` and ``n``, the number of rows
    that are so. All count in full. A tree's sample takes them in blocks of equal
    rows, single ones up to ``BLOCKS`` rows, so a fit over few patterns costs the
    same for a table of any size.
    """
    total = counted.agg(F.sum("n").alias("n")).first().n or 0
    blocks = F.ceil(F.col("n") / max(1, math.ceil(total / BLOCKS)))
    placed = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(counted.select("_fold", F.col("_y").cast("double").alias("_y"), "n", *features))
    known = placed.select("_fold", "_x", "_y", (F.col("n") / blocks).alias("_w"), F.explode(F.sequence(F.lit(1), blocks)))
    found = []
    for k in range(folds):
        model = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=6, seed=seed).fit(known.where(F.col("_fold") != k))
        found.append(model.transform(placed.where(F.col("_fold") == k)).select(F.col("_y").cast("int").alias("label"), vector_to_array("probability").alias("p"), "n"))
    return reduce(DataFrame.unionByName, found)


def _fold(folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(folds))


def provenance_auc(rows: DataFrame, features: list[str], source: str, sources: list, seed: int = 0, folds: int = 3, trees: int = 20) -> DataFrame:
    """Control 5: how well the features tell a row's source, as ``source, auc`` of one against the rest, and ``null`` for their mean.

    ``sources`` are the few values that are told apart. One source gives no rows.
    """
    if len(sources) < 2:
        return rows.sparkSession.createDataFrame([], "source string, auc double")
    number = F.array_position(F.array(*map(F.lit, sources)), F.col(source)) - 1
    counted = _counted(rows.where(F.col(source).isin(list(sources))).select(*features, number.alias("_y"), _fold(folds, seed).alias("_fold")), features, "_y", "_fold")
    each = F.explode(F.transform("p", lambda p, i: F.struct(i.alias("i"), p.alias("score")))).alias("e")
    own = F.when(F.col("label") == F.col("e.i"), F.col("n")).otherwise(0)
    long = _cross_scores(counted, features, folds, seed, trees).select("label", "n", each).select(F.element_at(F.array(*[F.lit(str(s)) for s in sources]), F.col("e.i") + 1).alias("source"), own.alias("p"), (F.col("n") - own).alias("q"), F.col("e.score").alias("score"))
    auc = curves.roc_auc(curves.counted_curve(long, ["source"]), ["source"])
    return auc.unionByName(auc.agg(F.lit(None).cast("string").alias("source"), F.avg("auc").alias("auc")))


def permuted_precision(rows: DataFrame, features: list[str], y: str, repeats: int = 3, folds: int = 3, trees: int = 20, tolerance: float = 0.10) -> DataFrame:
    """Control 6: labels are permuted, the model is fitted again and scored on them: ``repeat, average_precision, prevalence, within_tolerance``.

    ``row_id`` must be unique. One pass counts the rows of equal features, fold and permuted label for all repeats.
    """
    dealt = F.explode(F.array(*[F.struct(F.lit(k).alias("_repeat"), _fold(folds, k).alias("_fold"), leakage.dealt_labels(rows, y, k).alias("_y")) for k in range(repeats)])).alias("_d")
    counted = _counted(rows.select(*features, dealt).select(*features, "_d.*"), features, "_repeat", "_fold", "_y")
    found = []
    for k in range(repeats):
        scores = _cross_scores(counted.where(F.col("_repeat") == k), features, folds, k, trees)
        p = F.col("label") * F.col("n")
        points = scores.select(F.lit(k).alias("repeat"), F.element_at("p", 2).alias("score"), p.alias("p"), (F.col("n") - p).alias("q"))
        ap = curves.average_precision(curves.counted_curve(points, ["repeat"]), ["repeat"])
        rate = points.groupBy("repeat").agg((F.sum("p") / F.sum(F.col("p") + F.col("q"))).alias("prevalence"))
        found.append(ap.withColumnRenamed("ap", "average_precision").join(rate, "repeat"))
    out = reduce(DataFrame.unionByName, found)
    return out.withColumn("within_tolerance", F.abs(F.col("average_precision") - F.col("prevalence")) < tolerance)


# Metrics by fold


def low_support(rows: DataFrame, by: list[str], y: str) -> DataFrame:
    """``by, n, positives, low``: groups with too few positives for rates."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("positives")).withColumn("low", F.col("positives") < LEAST_SUPPORT)


def class_report(rows: DataFrame, truth: str, said: str, least: int = LEAST_SUPPORT) -> DataFrame:
    """``class, support, precision, recall, f1`` of every class that is true or said; no rates for classes of little support."""
    pair = F.explode(F.array_distinct(F.array(F.col(truth), F.col(said)))).alias("class")
    counts = rows.groupBy(truth, said).agg(F.count("*").alias("n")).select(truth, said, "n", pair)
    own, met = F.col(truth) == F.col("class"), F.col(said) == F.col("class")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    by = counts.groupBy("class").agg(total(own).alias("support"), total(met).alias("said"), total(own & met).alias("hits"))
    enough = F.col("support") >= least
    ratio = lambda a, b: F.when(enough, F.when(b > 0, a / b).otherwise(0.0))
    return by.select("class", "support", ratio(F.col("hits"), F.col("said")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("said")).alias("f1"))


def fold_metrics(scored: DataFrame, fold: str) -> DataFrame:
    """Per fold of ``y, score``: rows, positives, average precision, area under ROC; null metrics where a fold has one class only."""
    points, counts = curves.curve(scored, [fold]), low_support(scored, [fold], "y")
    ap, auc = curves.average_precision(points, [fold]), curves.roc_auc(points, [fold])
    joined = counts.join(ap, fold, "left").join(auc, fold, "left")
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return joined.select(fold, "n", "positives", "low", F.when(both, F.col("ap")).alias("ap"), F.when(both, F.col("auc")).alias("auc"))


def metric_bundle(scored: DataFrame, by: list[str], row: str, threshold: float = 0.5, most_fpr: float = 0.01) -> DataFrame:
    """Every metric of ``y, score`` by group: counts, average precision, area under ROC, rates at a threshold and at a false-positive rate, calibration error of each class, risk and coverage.

    Metrics of ranking and rates are null where a group has one class only. The
    points of the curve are made once for all that need them.
    """
    points = curves.curve(scored, by)
    sizes = scored.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("positives"))
    of_class = curves.calibration_error(scored, by).groupBy(*by).agg(F.max(F.when(F.col("y") == 1, F.col("ece"))).alias("ece_positive"), F.max(F.when(F.col("y") == 0, F.col("ece"))).alias("ece_negative"))
    wrong = (F.col("score") >= threshold) != (F.col("y") == 1)
    reach = curves.tpr_at_fpr(points, by, most_fpr).select(*by, F.col("tpr").alias("tpr_at_fpr"), F.col("threshold").alias("at_threshold"))
    parts = [curves.average_precision(points, by), curves.roc_auc(points, by), reach, curves.confusion(scored, by, threshold), of_class, curves.risk_coverage(scored, by, F.abs(F.col("score") - 0.5), row, wrong)]
    out = sizes
    for part in parts:
        out = out.join(part, by, "left")
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    ranked = ["ap", "auc", "tpr_at_fpr", "at_threshold", "mcc"]
    rest = ["precision", "recall", "ece_positive", "ece_negative", "aurc", "risk_full", "risk_half", "risk_fifth"]
    return out.select(*by, "n", "positives", "tp", "fp", "fn", "tn", *(F.when(both, F.col(c)).alias(c) for c in ranked), *rest)


def input_errors(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group how many rows metrics must not be made of: scores that are null or not finite, labels that are neither 0 nor 1."""
    score, y = F.col("score").cast("double"), F.col("y")
    bad = F.coalesce(F.isnan(score) | (F.abs(score) == float("inf")), F.lit(True))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad_scores"), F.count_if(F.coalesce(~y.isin(0, 1), F.lit(True))).alias("bad_labels"))


def require_clean(scored: DataFrame, by: list[str]) -> DataFrame:
    """The rows again, or ``ValueError`` naming a group with rows that metrics must not be made of."""
    r = input_errors(scored, by).where("bad_scores + bad_labels > 0").first()
    if r is not None:
        raise ValueError(f"{ {c: r[c] for c in by} }: {r.bad_scores} scores and {r.bad_labels} labels of {r.n} rows are no such")
    return scored


def fold_spread(metrics: DataFrame, value: str) -> DataFrame:
    """Mean of a metric over all folds and over those with support, each with its number of folds."""
    fine = F.when(~F.col("low"), F.col(value))
    return metrics.agg(F.count(value).alias("folds"), F.avg(value).alias("mean"), F.count(fine).alias("folds_supported"), F.avg(fine).alias("mean_supported"))


def false_alerts(counts: DataFrame, per_day: int = WINDOWS_PER_DAY) -> DataFrame:
    """Of ``fp`` and ``benign``: false alerts a day, and with none seen the bound of the rule of three."""
    seen = F.col("benign") > 0
    return counts.withColumns({"per_day": F.when(seen, F.col("fp") / F.col("benign") * per_day), "at_most": F.when(seen & (F.col("fp") == 0), 3 / F.col("benign") * per_day)})
