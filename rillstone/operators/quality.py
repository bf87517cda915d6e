"""Quality and monitoring reports: tables with one row for each feature, from one aggregate over all features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators import stats

POINTS = (0.25, 0.5, 0.75, 0.95)


def profile(df: DataFrame, features: list[str], exact: bool = False, points: tuple[float, ...] = POINTS) -> DataFrame:
    """(feature, n, present, mean, std, low, high, q25, q50, q75, q95): one pass; NaN counts as null.

    Percentiles are of a sketch of bounded size, right to a rank in ten
    thousand; exact ones take three passes more (see ``stats.quantiles``).
    Other points have columns named like these; none cost nothing.
    """
    values = {f"q{i}": F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for i, c in enumerate(features)}
    sketched = bool(points) and not exact
    aggs = [F.count("*").alias("n")]
    for i, x in enumerate(values.values()):
        aggs.append(F.struct(F.count(x).alias("present"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")).alias(f"f{i}"))
        if sketched:
            aggs.append(F.percentile_approx(x, list(points), F.lit(10_000)).alias(f"q{i}"))
    one = df.agg(*aggs)
    if points and exact:
        one = one.crossJoin(F.broadcast(stats.quantiles(df, values, points)))
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("f"), *([F.col(f"q{i}").alias("q")] if points else [])) for i, c in enumerate(features)])).alias("x"))
    return rows.select("x.feature", "n", "x.f.*", *[F.col("x.q")[i].alias(f"q{round(p * 100)}") for i, p in enumerate(points)])


def outside(df: DataFrame, profiled: DataFrame, features: list[str], low: Column, high: Column) -> DataFrame:
    """The profile with ``outliers``, the rows beyond bounds made from its columns; one pass, in which the profile goes along, so that it isn't made twice."""
    of = lambda c, x: F.max(F.when(F.col("feature") == c, x))
    bounds = profiled.agg(F.collect_list(F.struct(*profiled.columns)).alias("__p"), *[of(c, x).alias(f"__{n}{i}") for i, c in enumerate(features) for n, x in (("low", low), ("high", high))])
    beyond = [F.count_if((F.col(f"`{c}`") < F.col(f"__low{i}")) | (F.col(f"`{c}`") > F.col(f"__high{i}"))).alias(f"c{i}") for i, c in enumerate(features)]
    counted = df.crossJoin(F.broadcast(bounds)).agg(F.any_value("__p").alias("p"), *beyond)
    row = lambda c: F.get(F.filter("p", lambda f: f["feature"] == c), F.lit(0))
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), row(c).alias("p"), F.col(f"c{i}").alias("outliers")) for i, c in enumerate(features)])).alias("x"))
    kept = [F.coalesce(F.col(f"x.p.{c}"), F.lit(0).cast("long")).alias(c) if c in ("n", "present") else F.col(f"x.p.{c}") for c in profiled.columns if c != "feature"]  # a table without rows has no profile
    return rows.select("x.feature", *kept, "x.outliers")


def anomalies(df: DataFrame, features: list[str], method: str = "iqr", width: float | None = None, exact: bool = False) -> DataFrame:
    """(feature, present, outliers, share): beyond 1.5 quartile ranges, or beyond 3 standard deviations."""
    c, points = F.col, ()
    if method == "iqr":
        points = (0.25, 0.75)
        k = 1.5 if width is None else width
        low, high = c("q25") - k * (c("q75") - c("q25")), c("q75") + k * (c("q75") - c("q25"))
    elif method == "zscore":
        k = 3.0 if width is None else width
        low, high = c("mean") - k * c("std"), c("mean") + k * c("std")
    else:
        raise ValueError(f"no such method: {method}")
    return outside(df, profile(df, features, exact, points), features, low, high).select("feature", "present", "outliers", F.coalesce(F.try_divide(c("outliers"), c("present")), F.lit(0.0)).alias("share"))


def change(now: Column, before: Column) -> Column:
    """Relative change; 0 if both are 0, 1 if only the earlier is."""
    return F.when(before == 0, F.when(now == 0, 0.0).otherwise(1.0)).otherwise(F.abs(now - before) / F.abs(before))


def drift(current: DataFrame, reference: DataFrame, features: list[str], threshold: float = 0.1, exact: bool = False) -> DataFrame:
    """(feature, mean_change, std_change, median_change, drift, drifted): relative changes against the reference and their mean."""
    a, b = profile(current, features, exact, (0.5,)).alias("a"), profile(reference, features, exact, (0.5,)).alias("b")
    pairs = (("mean", "mean_change"), ("std", "std_change"), ("q50", "median_change"))
    joined = a.join(F.broadcast(b), "feature").select("feature", *[F.coalesce(change(F.col(f"a.{x}"), F.col(f"b.{x}")), F.lit(0.0)).alias(n) for x, n in pairs])  # one row for each feature
    score = (F.col("mean_change") + F.col("std_change") + F.col("median_change")) / 3
    return joined.withColumn("drift", score).withColumn("drifted", F.col("drift") > threshold)


def steps(x: Column, bounds: list[tuple[float, float]], last: float) -> Column:
    """The score of the first bound that x is below."""
    out = None
    for bound, score in bounds:
        out = (F if out is None else out).when(x < bound, score)
    return out.otherwise(last)


def quality_report(df: DataFrame, features: list[str], reference: DataFrame | None = None, threshold: float = 0.8, exact: bool = False) -> DataFrame:
    """(feature, null_score, outlier_score, distribution_score, drift_score, overall, ok); without a reference nothing has drifted."""
    c = F.col
    spread = c("q75") - c("q25")
    report = outside(df, profile(df, features, exact, (0.25, 0.5, 0.75)), features, c("q25") - 1.5 * spread, c("q75") + 1.5 * spread)
    if reference is None:
        report = report.withColumn("shift", F.lit(0.0))
    else:
        earlier = profile(reference, features, points=()).select("feature", c("mean").alias("mean_before"), c("std").alias("std_before"))
        moved = [F.coalesce(change(c(x), c(f"{x}_before")), F.lit(0.0)) for x in ("mean", "std")]
        report = report.join(F.broadcast(earlier), "feature").withColumn("shift", (moved[0] + moved[1]) / 2)  # one row for each feature
    nulls = F.greatest(F.lit(0.0), 1 - 2 * (1 - F.coalesce(F.try_divide(c("present"), c("n")), F.lit(0.0))))
    beyond = F.coalesce(F.try_divide(c("outliers"), c("present")), F.lit(0.0))
    skew = F.abs(c("mean") - c("q50")) / F.nullif(c("std"), F.lit(0.0))
    out = report.select(
        "feature",
        nulls.alias("null_score"),
        steps(beyond, [(0.05, 1.0), (0.10, 0.8), (0.20, 0.5)], 0.2).alias("outlier_score"),
        F.when(skew.isNull(), 0.3).otherwise(steps(skew, [(0.1, 1.0), (0.5, 0.8), (1.0, 0.6)], 0.4)).alias("distribution_score"),
        steps(c("shift"), [(0.05, 1.0), (0.10, 0.8), (0.20, 0.6), (0.50, 0.4)], 0.2).alias("drift_score"),
    )
    overall = 0.3 * c("null_score") + 0.3 * c("outlier_score") + 0.2 * c("distribution_score") + 0.2 * c("drift_score")
    return out.withColumn("overall", overall).withColumn("ok", c("overall") >= threshold)


def score_rows(df: DataFrame, features: list[str], exact: bool = False) -> DataFrame:
    """df with null_share and outlier_share, of the row's features, and row_quality, 1 less half of either; the quartiles are a broadcast row for each feature."""
    p = profile(df, features, exact, (0.25, 0.75))
    spread = F.col("q75") - F.col("q25")
    bounds = p.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct((F.col("q25") - 1.5 * spread).alias("low"), (F.col("q75") + 1.5 * spread).alias("high"))))).alias("__b"))
    x = lambda c: F.col(f"`{c}`").cast("double")
    missing = sum((F.when(x(c).isNull() | F.isnan(x(c)), 1.0).otherwise(0.0) for c in features), F.lit(0.0))
    beyond = sum((F.when((x(c) < F.element_at("__b", F.lit(c))["low"]) | (x(c) > F.element_at("__b", F.lit(c))["high"]), 1.0).otherwise(0.0) for c in features), F.lit(0.0))
    scored = df.crossJoin(F.broadcast(bounds)).withColumns({"null_share": missing / len(features), "outlier_share": beyond / len(features)})
    return scored.withColumn("row_quality", 1 - 0.5 * F.col("null_share") - 0.5 * F.col("outlier_share")).drop("__b")


def recommendations(report: DataFrame) -> DataFrame:
    """What to do about each feature of a quality report."""
    advice = F.filter(
        F.array(
            F.when(F.col("null_score") < 0.8, "fill or drop missing values"),
            F.when(F.col("outlier_score") < 0.8, "clip or transform outliers"),
            F.when(F.col("distribution_score") < 0.6, "transform the skewed or constant distribution"),
            F.when(F.col("drift_score") < 0.6, "retrain, or look for a change at the source"),
        ),
        lambda x: x.isNotNull(),
    )
    return report.withColumn("recommendations", advice)


def completeness(df: DataFrame, features: list[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))).alias(f"c{i}") for i, c in enumerate(features)])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("present")) for i, c in enumerate(features)])).alias("x")).select("n", "x.*")
    c = F.col("present") / F.col("n")
    return rows.select("feature", c.alias("completeness"), F.when(c >= 0.95, "excellent").when(c >= 0.90, "good").when(c >= 0.75, "fair").otherwise("poor").alias("status"))


def freshness(df: DataFrame, time: str, now: Column | None = None) -> DataFrame:
    """One row: the latest time, its age in hours, and fresh (24 h), stale (48 h) or very_stale; a table without times is very stale."""
    now = F.current_timestamp() if now is None else now
    hours = (now.cast("timestamp").cast("long") - F.col("latest").cast("timestamp").cast("long")) / 3600.0
    return df.agg(F.max(time).alias("latest")).select("latest", hours.alias("age_hours"), F.when(hours <= 24, "fresh").when(hours <= 48, "stale").otherwise("very_stale").alias("status"))


def monitor(df: DataFrame, features: list[str], reference: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(feature, completeness, anomaly_share, drift, status): healthy unless a check fails; unhealthy if half of them do."""
    parts = completeness(df, features).select("feature", "completeness").join(F.broadcast(anomalies(df, features, exact=exact).select("feature", F.col("share").alias("anomaly_share"))), "feature")
    if reference is None:
        parts = parts.withColumn("drift", F.lit(0.0))
    else:
        parts = parts.join(F.broadcast(drift(df, reference, features, exact=exact).select("feature", "drift")), "feature")
    failed = (F.col("completeness") < 0.9).cast("int") + (F.col("anomaly_share") > 0.1).cast("int") + (F.col("drift") > 0.1).cast("int")
    return parts.withColumn("status", F.when(failed == 0, "healthy").when(failed * 2 < 3, "degraded").otherwise("unhealthy"))


def alerts(report: DataFrame, thresholds: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(feature, metric, value, threshold) of what is beyond: {metric: ("<" or ">", bound)}."""
    rules = thresholds or {"completeness": ("<", 0.9), "anomaly_share": (">", 0.1), "drift": (">", 0.1)}
    rows = []
    for metric, (way, bound) in rules.items():
        hit = F.col(metric) < bound if way == "<" else F.col(metric) > bound
        rows.append(F.when(hit, F.struct(F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"), F.lit(float(bound)).alias("threshold"))))
    return report.select("feature", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("a")).select("feature", "a.*")
