"""Evaluation of scores against labels as DataFrame plans: ranking metrics, confusion, threshold choice.

Every ranking metric first sums labels per distinct score, so sorts and windows run over distinct scores of a group, and a
group's rows are combined before they are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.ranks import running


def ranking(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """(by, n, positives, auroc, average_precision, aupr_trapezoid); the metrics are null where a group has one label only.

    Positives and rows above a score are running sums over parts of a group, so no group's scores are ordered in one task.
    """
    per = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n"))
    c = running(per, by, [F.desc("s")], {"tp0": F.col("p"), "seen0": F.col("n")})
    tp, seen, negatives = F.col("tp0") + F.col("p"), F.col("seen0") + F.col("n"), F.col("n") - F.col("p")
    precision, before = tp / seen, F.when(F.col("seen0") == 0, 1.0).otherwise(F.try_divide("tp0", "seen0"))
    out = c.groupBy(*by).agg(
        F.sum("n").alias("__n"), F.sum("p").alias("positives"), F.sum(F.col("p") * (seen - tp - negatives / 2)).alias("__above"),
        F.sum(F.col("p") * precision).alias("__ap"), F.sum(F.col("p") * (precision + before) / 2).alias("__trap"),
    )
    two = (F.col("positives") > 0) & (F.col("positives") < F.col("__n"))
    pairs = F.col("positives") * (F.col("__n") - F.col("positives"))
    return out.select(
        *by, F.col("__n").alias("n"), "positives", F.when(two, (pairs - F.col("__above")) / pairs).alias("auroc"),
        F.when(two, F.col("__ap") / F.col("positives")).alias("average_precision"), F.when(two, F.col("__trap") / F.col("positives")).alias("aupr_trapezoid"),
    )


def confusion(df: DataFrame, by: list[str], predicted: Column, label: str = "label") -> DataFrame:
    y = F.col(label) == 1
    return df.groupBy(*by).agg(F.count_if(predicted & y).alias("tp"), F.count_if(predicted & ~y).alias("fp"), F.count_if(~predicted & ~y).alias("tn"), F.count_if(~predicted & y).alias("fn"))


def rates(c: DataFrame) -> DataFrame:
    """Columns of a confusion table with accuracy, sensitivity, specificity, precision, f1, mcc; 0 over an empty denominator."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp),
        "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": ratio(tp * tn - fp * fn, root),
    })


def classified(df: DataFrame, by: list[str], cut: float, strict: bool = False, label: str = "label", score: str = "score") -> DataFrame:
    return rates(confusion(df, by, F.col(score) > cut if strict else F.col(score) >= cut, label))


def macro(df: DataFrame, group: str, label: str = "label", score: str = "score") -> DataFrame:
    """One row: mean AUROC and average precision over the groups with both labels, and how many those are."""
    per = ranking(df, [group], label, score)
    return per.agg(F.avg("auroc").alias("macro_auroc"), F.avg("average_precision").alias("macro_auprc"), F.count("auroc").alias("eligible"))


def at_cuts(df: DataFrame, cuts: DataFrame, strict: bool = False, label: str = "label", score: str = "score") -> DataFrame:
    """rates for each row of cuts (column cut, a few hundred at most): labels are first summed per distinct score, and each
    score counts for the cuts below it, so the data is read once."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n"))
    hit = F.col("s") > F.col("cut") if strict else F.col("s") >= F.col("cut")
    both = per.join(F.broadcast(cuts.distinct()))
    c = both.groupBy("cut").agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("p")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("n") - F.col("p"))).alias("tn"), F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"),
    )
    return rates(c)


def grid_cuts(spark, steps: int = 200) -> DataFrame:
    """1/steps to (steps-1)/steps."""
    return spark.range(1, steps).select((F.col("id") / steps).alias("cut"))


def quantiles(df: DataFrame, levels: list[float], score: str = "score") -> DataFrame:
    """(level, value): exact linear quantiles of the non-null scores at each level; no rows without a score.

    Scores are counted per distinct value and a running count says which values hold the two ranks that a level lies between,
    so memory is bounded whatever the scores are. NaN is above infinity.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"))
    c = running(per, [], ["s"], {"seen": F.col("n")}).checkpoint()
    last = (c.agg(F.sum("n")).first()[0] or 0) - 1
    if last < 0:
        return df.sparkSession.createDataFrame([], "level double, value double")
    at = {q: q * last for q in levels}
    ranks = sorted({r for x in at.values() for r in (math.floor(x), math.ceil(x))})  # two a level at most
    held = F.filter(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r >= F.col("seen")) & (r < F.col("seen") + F.col("n")))
    value = {r["rank"]: r["s"] for r in c.select("s", F.explode(held).alias("rank")).collect()}

    def between(x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        return value[low] if value[low] == value[high] else (high - x) * value[low] + (x - low) * value[high]

    return df.sparkSession.createDataFrame([(float(q), float(between(x))) for q, x in at.items()], "level double, value double")


def quantile_cuts(df: DataFrame, low: float, high: float, number: int, score: str = "score") -> DataFrame:
    """Distinct linear quantiles of the score at `number` even levels."""
    levels = [round(low + (high - low) * i / (number - 1), 12) for i in range(number)]
    return quantiles(df, levels, score).select(F.col("value").alias("cut")).distinct()


def best_cut(table: DataFrame, metric: str, ties: list[Column]) -> DataFrame:
    """The row of the highest metric; of equal ones the first by ties. Metrics are compared to 12 digits."""
    return table.orderBy(F.round(metric, 12).desc(), *ties).limit(1)


def single_threshold(df: DataFrame, threshold: str = "threshold", score: str = "score") -> DataFrame:
    """One row: distinct thresholds, and rows with a score or threshold that is null, not finite or outside [0, 1]."""
    wrong = lambda c: F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(0, 1)
    return df.agg(F.countDistinct(threshold).alias("thresholds"), F.count_if(wrong(threshold) | wrong(score)).alias("bad_rows"))


def log_loss(df: DataFrame, label: str = "label", score: str = "score", least: float = 1e-7) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(least)), F.lit(1 - least))
    return df.agg(F.sum(F.when(F.col(label) == 1, -F.ln(p)).otherwise(-F.ln(1 - p))).alias("bce"))
