"""Research around models and thresholds: models to compare, evaluation, perturbed inputs and graphs, when to search again and what to adopt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import windows as W

MODELS = ("logistic", "boosted", "perceptron", "random")


def fit_scores(train: DataFrame, apply: DataFrame, columns: list[str], model: str = "logistic", label: str = "y", seed: int = 42) -> DataFrame:
    """``apply`` with a score from 0 to 1 by one of MODELS: logistic regression, boosted trees of depth three, a perceptron with sixteen hidden
    units, or a draw by hash, which is the floor for the others. Without both labels in ``train`` the score is its only label."""
    from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tidewatch.operators.learn import fit_score

    if model not in MODELS:
        raise ValueError(f"no model {model}; known: {', '.join(MODELS)}")
    leaks = sorted(set(columns) & {label, "part", "outcome"})
    if leaks:
        raise ValueError(f"features that tell the label: {', '.join(leaks)}")
    if model == "random":
        return apply.withColumn("score", uniform(F.concat_ws(":", *(F.col(c).cast("string") for c in columns)), seed))
    if model == "logistic":
        return fit_score(train, apply, columns, label)
    t = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("p")).first()
    if t.p == 0 or t.p == t.n:
        return apply.withColumn("score", F.lit(float(t.p > 0)))
    pack = VectorAssembler(inputCols=columns, outputCol="_v")
    scale = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(pack.transform(train))
    ready = lambda rows: scale.transform(pack.transform(rows))
    names = {"featuresCol": "_x", "labelCol": label, "seed": seed}
    made = GBTClassifier(maxDepth=3, maxIter=20, **names) if model == "boosted" else MultilayerPerceptronClassifier(layers=[len(columns), 16, 2], maxIter=100, **names)
    return made.fit(ready(train)).transform(ready(apply)).withColumn("score", vector_to_array("probability")[1]).drop("_v", "_x", "probability", "rawPrediction", "prediction")


def uniform(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) from a hash of the key: the same in every run and on every cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(seed)))), 1, 8), 16, 10).cast("long") / 4294967296.0


def curve(scored: DataFrame, label: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct score (within each ``by``): positives and rows at or above it (tp, k), rows and positives in all, and the mean rank from below."""
    g = scored.groupBy(*by, F.col("score").cast("double").alias("score")).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    g = W.running_sums(g, "score", ["p", "n"], by=by).withColumnsRenamed({"all_p": "pos", "all_n": "tot"})
    return g.select(*by, "score", "p", "n", "pos", "tot", (F.col("pos") - F.col("run_p") + F.col("p")).alias("tp"), (F.col("tot") - F.col("run_n") + F.col("n")).alias("k"), (F.col("run_n") - (F.col("n") - 1) / 2).alias("rank"))


def evaluate(scored: DataFrame, label: str = "y", recall: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (one for each ``by``): average_precision, auroc, and the threshold of the greatest precision among those that reach the recall, with both."""
    c = curve(scored, label, by)
    pos, tot = F.first("pos"), F.first("tot")
    precision, reached = F.col("tp") / F.col("k"), F.col("tp") >= recall * F.col("pos")
    best = F.max(F.when(reached, F.struct(precision.alias("precision"), F.col("tp").alias("tp"), F.col("score").alias("threshold"))))
    out = c.groupBy(*by).agg(F.sum(F.try_divide(F.col("p"), F.col("pos")) * precision).alias("average_precision"), F.try_divide(F.sum(F.col("p") * F.col("rank")) - pos * (pos + 1) / 2, pos * (tot - pos)).alias("auroc"), best.alias("b"), pos.alias("pos"))
    return out.select(*by, "average_precision", "auroc", F.col("b.threshold").alias("threshold"), F.col("b.precision").alias("precision"), F.try_divide("b.tp", "pos").alias("recall"))


def noised(rows: DataFrame, columns: list[str], scale: float, key: str, seed: int = 42) -> DataFrame:
    """Columns with noise of a share of their own spread: a sum of hash draws, close to normal, the same in every run."""
    if not scale:
        return rows
    spread = rows.agg(*(F.stddev_samp(c).alias(f"_s{k}") for k, c in enumerate(columns)))
    draw = lambda c: (sum((uniform(F.col(key).cast("string"), f"{seed}:{c}:{k}") for k in range(12)), F.lit(0.0)) - 6)
    out = rows.join(F.broadcast(spread))
    return out.withColumns({c: F.col(c) + scale * F.col(f"_s{k}") * draw(c) for k, c in enumerate(columns)}).drop(*(f"_s{k}" for k in range(len(columns))))


def rewired(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """edges (u, v, w) of which a share by hash gets another second end: that of another chosen edge, next in the order of a second hash within
    one of 64 buckets. So the degrees of the ends stay."""
    from pyspark.sql.window import Window

    named = F.concat_ws(":", "u", "v")
    marked = edges.withColumn("_h", uniform(named, seed))
    chosen = marked.where(F.col("_h") < share).withColumn("_o", F.md5(F.concat_ws(":", named, F.lit(f"{seed}o")))).withColumn("_b", F.pmod(F.xxhash64("_o"), F.lit(64)))
    w = Window.partitionBy("_b")
    order = w.orderBy("_o", "u", "v")
    swapped = chosen.select("u", F.coalesce(F.lead("v").over(order), F.first("v").over(order)).alias("v"), "w").where("u != v")
    both = marked.where(F.col("_h") >= share).select("u", "v", "w").unionByName(swapped)
    return both.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))


def search_due(report: dict | None, year: int) -> bool:
    """Thresholds are searched anew where there is no report or none for the year."""
    return not report or str(year) not in {str(y) for y in report.get("thresholds", {})}


def adopted(old: dict, new: dict) -> bool:
    """A candidate takes over if it is of more use, no worse lately and no worse in all."""
    return new["utility"] > old["utility"] and new["recent"] >= old["recent"] and new["total"] >= old["total"]


def parsimonious(results: list[dict], tolerance: float = 0.01) -> dict | None:
    """Of the results within a tolerance of the best score the one with the fewest features; ties go to the better score, then to the name."""
    if not results:
        return None
    best = max(r["score"] for r in results)
    return min((r for r in results if r["score"] >= best - tolerance), key=lambda r: (r["features"], -r["score"], r["name"]))


def review_due(last: str | None, today: str) -> bool:
    """A monthly review: due in each month that has none yet."""
    return last is None or last[:7] < today[:7]
