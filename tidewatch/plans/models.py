"""Queries that fit models; they have no SQL and are held to their properties in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import influence as I
from tidewatch.operators import learn as L
from tidewatch.plans import crowd as K
from tidewatch.plans import influence as A
from tidewatch.plans import judging as J
from tidewatch.plans import people as N

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def logistic_walk_forward(spark, d):
    """The probability that a peak is near, by a model of the earlier years' components."""
    cols = ["e1", "e2", "e3", "e5", "faded"]
    f = K.cut_detector(spark, d).withColumn("faded", F.col("fade").cast("double")).dropna(subset=cols)
    rows = f.join(J.labels(spark, d).select("entity", "day", F.col("y_top").alias("y")), ["entity", "day"]).withColumn("year", F.year("day"))
    rows = rows.select("entity", "day", "year", "y", *cols).checkpoint()
    return L.walk_forward(rows, cols).select("entity", "day", "year", "y", "score")


@query
def sage_lite(spark, d):
    """Authors by their own columns and their neighbours' means, fitted on the training part."""
    n = A.nodes(spark, d)
    x = I.neighbour_mean(n.select("node", "n", "v"), N.edges(spark, d), ["n", "v"]).join(I.split(n, "node", "y").select("node", "y", "part"), "node")
    return L.fit_score(x.where("part = 'train'"), x, ["n", "v", "nb_n", "nb_v"]).select("node", "part", "y", "score")
