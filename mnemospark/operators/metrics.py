"""Aggregates over search observations, one flat row a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENCIES = ("latency_ms", "router_latency_ms", "multi_hop_latency_ms")


def search_metrics(observations: DataFrame, counters: list[str], latencies: tuple[str, ...] = LATENCIES) -> DataFrame:
    """One row: searches, sums of counters, and of each latency the calls that have it, their mean (3 places) and maximum."""
    sums = [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in counters]
    times = [x for c in latencies for x in (F.count(c).alias(f"{c}_calls"), F.round(F.avg(c), 3).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"))]
    return observations.agg(F.count("*").alias("searches"), *sums, *times)


def category_counts(observations: DataFrame, categories: list[str]) -> DataFrame:
    """(dimension, value, n) over the category columns; null and empty values are skipped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in categories])
    rows = observations.select(F.inline(pairs)).where("value <> ''")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sums of batches, merged when they are read

PARTIAL = "name string, n bigint, whole bigint, total double, top double"


def partial_metrics(observations: DataFrame, counters: list[str], latencies: tuple[str, ...] = LATENCIES) -> DataFrame:
    """What search_metrics needs of one batch, a row a name: rows of several batches add up."""
    nothing = F.lit(None)
    row = lambda name, n, whole, total, top: F.struct(F.lit(name).alias("name"), n.cast("long").alias("n"), whole.cast("long").alias("whole"), total.cast("double").alias("total"), top.cast("double").alias("top"))
    rows = [row("searches", F.count("*"), F.count("*"), nothing, nothing)]
    rows += [row(f"counter {c}", F.count(c), F.sum(F.col(c).cast("long")), nothing, nothing) for c in counters]
    rows += [row(f"latency {c}", F.count(c), nothing, F.sum(c), F.max(c)) for c in latencies]
    return observations.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def added_partials(partials: DataFrame) -> DataFrame:
    """One row a name."""
    return partials.groupBy("name").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"), F.sum("total").alias("total"), F.max("top").alias("top"))


def merged_metrics(partials: DataFrame, counters: list[str], latencies: tuple[str, ...] = LATENCIES) -> DataFrame:
    """The row of search_metrics over all batches."""
    of = lambda name, column: F.when(F.col("name") == name, F.col(column))
    total = lambda name, column: F.coalesce(F.sum(of(name, column)), F.lit(0))
    sums = [total(f"counter {c}", "whole").alias(c) for c in counters]
    times = []
    for c in latencies:
        n = total(f"latency {c}", "n")
        times += [n.alias(f"{c}_calls"), F.round(F.when(n > 0, F.sum(of(f"latency {c}", "total")) / n), 3).alias(f"{c}_mean"), F.max(of(f"latency {c}", "top")).alias(f"{c}_max")]
    return partials.agg(total("searches", "whole").alias("searches"), *sums, *times)
