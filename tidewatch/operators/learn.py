"""Models fitted on the past only, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_score(train: DataFrame, apply: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """Logistic regression with balanced classes and the L2 strength 1/n on unscaled columns; ``apply`` with a score from 0 to 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    t = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("p")).first()
    pack = VectorAssembler(inputCols=columns, outputCol="_x")
    if t.p == 0 or t.p == t.n:
        return apply.withColumn("score", F.lit(float(t.p > 0)))
    weight = F.when(F.col(label) == 1, t.n / (2.0 * t.p)).otherwise(t.n / (2.0 * (t.n - t.p)))
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1.0 / t.n, standardization=False, maxIter=50, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")
    fitted = model.fit(pack.transform(train.withColumn("_w", weight)))
    return fitted.transform(pack.transform(apply)).withColumn("score", vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_c")


def walk_forward(rows: DataFrame, columns: list[str], label: str = "y", least: int = 3) -> DataFrame:
    """rows (year, columns, label): each year scored by a model of the years before it, if these hold enough positives. One fit a year."""
    years = [r.year for r in rows.select("year").distinct().orderBy("year").collect()]
    out = None
    for year in years[1:]:
        past = rows.where(F.col("year") < year)
        if past.where(F.col(label) == 1).limit(least).count() < least:
            continue
        scored = fit_score(past, rows.where(F.col("year") == year), columns, label)
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else rows.limit(0).withColumn("score", F.lit(None).cast("double"))
