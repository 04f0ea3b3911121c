"""Model algebra and counts as relations: rates (i, j, value), distributions (i, p), and long counts (cpt, kind, i, j, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exchangeable(s: DataFrame, pi: DataFrame) -> DataFrame:
    """Rates s_ij pi_j of exchangeabilities s (i, j, s), with pi_i as p."""
    return s.join(pi, "i").join(pi.select(F.col("i").alias("j"), F.col("p").alias("pj")), "j").select("i", "j", (F.col("s") * F.col("pj")).alias("rate"), "p")


def expected_rate(rates: DataFrame, pi: DataFrame) -> DataFrame:
    """One row: expected substitutions a unit of time."""
    return rates.join(pi, "i").agg(F.sum(F.col("rate") * F.col("p")).alias("whole"))


def normalised(rates: DataFrame, pi: DataFrame) -> DataFrame:
    """Rates at one expected substitution a unit of time. The divisor is one row."""
    return rates.select("i", "j", "rate").join(F.broadcast(expected_rate(rates.select("i", "j", "rate"), pi))).select("i", "j", (F.col("rate") / F.col("whole")).alias("rate"))


def indel_length(extension: float) -> Column:
    """The mean length of an indel that extends with this probability."""
    return 1 / (1 - F.lit(extension))


def decay_wait(rate: Column, t: Column) -> Column:
    """The expected time of a decay that is known to happen within t."""
    return 1 / rate - t / F.expm1(rate * t)


def maximised(counts: DataFrame) -> DataFrame:
    """The M step on long counts: rates (cpt, i, j, rate) as substitutions by waiting times; states without waiting time have none."""
    wait = counts.where("kind = 'wait' AND value > 0").select("cpt", "i", F.col("value").alias("wait"))
    return counts.where("kind = 'sub'").join(wait, ["cpt", "i"]).select("cpt", "i", "j", (F.col("value") / F.col("wait")).alias("rate"))


def expected_loglik(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """One row: the expected log likelihood of substitutions and waiting times under rates (cpt, i, j, rate), with 0 log 0 = 0."""
    sub = counts.where("kind = 'sub'").select("cpt", "i", "j", F.col("value").alias("n"))
    wait = counts.where("kind = 'wait'").select("cpt", "i", F.col("value").alias("wait"))
    both = rates.join(sub, ["cpt", "i", "j"], "left").join(wait, ["cpt", "i"], "left")
    events = F.when(F.coalesce("n", F.lit(0.0)) == 0, 0.0).otherwise(F.col("n") * F.log("rate"))
    return both.agg((F.sum(events) - F.sum(F.col("rate") * F.coalesce("wait", F.lit(0.0)))).alias("loglik"))


def times(counts: DataFrame, factor: float) -> DataFrame:
    """Long counts times a number."""
    return counts.withColumn("value", F.col("value") * factor)


def summary(ratios: DataFrame) -> DataFrame:
    """Mean and root mean square error of ratios (method, r) of estimates to true values."""
    r = F.col("r")
    return ratios.groupBy("method").agg(F.avg(r).alias("mean"), F.sqrt(F.avg(r * r) - 2 * F.avg(r) + 1).alias("rmse"))


def quartiles(ratios: DataFrame) -> DataFrame:
    """The values at places n / 4, n / 2 and 3 n / 4 (rounded down) of each method's n ratios in order; none between two values."""
    w = Window.partitionBy("method")
    k = ratios.withColumn("k", F.row_number().over(w.orderBy("r")) - 1).withColumn("n", F.count("*").over(w))
    return k.groupBy("method").agg(*[F.max(F.when(F.expr(f"k = {e}"), F.col("r"))).alias(name) for e, name in (("n div 4", "q1"), ("n div 2", "median"), ("3 * n div 4", "q3"))])


def histogram(ratios: DataFrame, width: float) -> DataFrame:
    """How many ratios of each method are nearest to each multiple of width."""
    return ratios.groupBy("method", F.round(F.col("r") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
