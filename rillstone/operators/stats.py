"""Statistics, scores and scaling; each is one pass over the table, two where values are compared with totals, and three more for exact percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task may hold. Groups of more are few, so what is known of them is broadcast.
GROUP = 1_000_000


def _q(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _match(df: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df with its group's row, which is broadcast; null is a key like others."""
    if not by:
        return df.crossJoin(F.broadcast(groups))
    keys = {c: f"__key{i}" for i, c in enumerate(by)}
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in keys.items()])
    return df.join(F.broadcast(groups.withColumnsRenamed(keys)), same, how).drop(*keys.values())


def by_size(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """df's rows of groups of more than ``GROUP`` rows, and the rest."""
    large = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > GROUP).select(*by)
    return _match(df, large, by, "left_semi"), _match(df, large, by, "left_anti")


def basic(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    aggs = [f(_q(c)).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("stddev", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return df.groupBy(*(by or [])).agg(*aggs)


#: A sketch of this accuracy gives bounds of the stretch around a point that is looked at closely: this share of the rows on either side.
ACCURACY, MARGIN = 2000, 0.001


def quantiles(df: DataFrame, values: dict[str, Column], points: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(*by, a column for each value): arrays of exact percentiles at the points, interpolated; null without values, NaN is the highest.

    No task holds the distinct values. A sketch cuts each column's range close
    to the points, a second pass counts the rows between and at the cuts, and
    a third counts the values of those stretches alone that hold a wanted
    rank. The sketch decides how much the third has to do, not the result.
    Groups are broadcast, so they should be few (see ``by_size``).
    """
    by = list(by or [])
    x = F.col("__x")
    data = df.select(*[F.col(f"`{k}`") for k in by], *[v.cast("double").alias(f"__x{i}") for i, v in enumerate(values.values())])

    def long(table, prefix, name):  # a row for each column
        return table.select(*[F.col(f"`{k}`") for k in by], F.explode(F.array(*[F.struct(F.lit(i).alias("__c"), F.col(f"{prefix}{i}").alias(name)) for i in range(len(values))])).alias("__v")).select(*[F.col(f"`{k}`") for k in by], "__v.*").where(F.col(name).isNotNull())

    marks = sorted({min(1.0, max(0.0, p + d)) for p in points for d in (-MARGIN, MARGIN)})
    cuts = long(data.groupBy(*by).agg(*[F.percentile_approx(f"__x{i}", marks, F.lit(ACCURACY)).alias(f"__s{i}") for i in range(len(values))]), "__s", "__s")
    where = sum(((x > F.get("__s", F.lit(j))).cast("int") + (x >= F.get("__s", F.lit(j))).cast("int") for j in range(len(marks))), F.lit(0))
    rows, key = long(data, "__x", "__x"), [*by, "__c"]
    part = _match(rows, cuts, key).groupBy(*key, where.alias("__part")).agg(F.count("*").alias("__rows"), F.min(x).alias("__low"), F.max(x).alias("__high"))
    w = Window.partitionBy(*key)
    part = part.withColumns({"__n": F.sum("__rows").over(w), "__end": F.sum("__rows").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))})

    at = [F.lit(float(p)) * (F.col("__n") - 1) for p in points]  # where the points lie among the ranks from 0
    held = lambda rank: (rank >= F.col("__end") - F.col("__rows")) & (rank < F.col("__end"))
    wanted = part.where(reduce(lambda a, b: a | b, [held(f(r)) for r in at for f in (F.floor, F.ceil)])).select(*key, "__n", (F.col("__end") - F.col("__rows")).alias("__first"), "__low", "__high")
    near = _match(rows, wanted, key).where(x.between(F.col("__low"), F.col("__high"))).groupBy(*key, "__n", "__first", "__x").agg(F.count("*").alias("__rows"))
    w = Window.partitionBy(*key, "__n", "__first").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__end", F.col("__first") + F.sum("__rows").over(w))
    found = near.groupBy(*key, "__n").agg(*[F.max(F.when(held(f(r)), x)).alias(f"__{k}{n}") for k, r in enumerate(at) for n, f in (("low", F.floor), ("high", F.ceil))])
    ends = [(F.col(f"__{k}low"), F.col(f"__{k}high")) for k in range(len(points))]
    q = F.array(*[F.when(low == high, low).otherwise((F.ceil(r) - r) * low + (r - F.floor(r)) * high) for (low, high), r in zip(ends, at)])
    out = found.select(*key, q.alias("__q")).groupBy(*by).agg(*[F.max(F.when(F.col("__c") == i, F.col("__q"))).alias(name) for i, name in enumerate(values)])
    return _match(df.select(*[F.col(f"`{k}`") for k in by]).distinct(), out, by, "left") if by else out


def percentiles(df: DataFrame, columns: list[str], points=(0.25, 0.5, 0.75, 0.95), by: list[str] | None = None, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Exact ones read the table three times, and more for groups; ``exact=False`` uses a bounded sketch."""
    if exact:
        out = _quantiles(df, columns, tuple(points), by)
    else:
        out = df.groupBy(*(by or [])).agg(*[F.percentile_approx(_q(c), list(points), accuracy).alias(f"__{c}_q") for c in columns])
    return out.select(*(by or []), *[F.col(f"`__{c}_q`")[i].alias(f"{c}_p{round(p * 100)}") for c in columns for i, p in enumerate(points)])


def _quantiles(df: DataFrame, columns: list[str], points: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(*by, ``__{c}_q``): exact percentiles of any number of groups; a task holds the values of small ones."""
    names = {f"__{c}_q": _q(c) for c in columns}
    if not by:
        return quantiles(df, names, points)
    large, rest = by_size(df, by)
    return quantiles(large, names, points, by).union(rest.groupBy(*by).agg(*[F.percentile(x, F.array(*map(F.lit, points))).alias(n) for n, x in names.items()]))


def z_scores(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """df with ``{c}_zscore``, within groups if there are any; 0 where the deviation is 0 or null, and for nulls. Rows of large groups stay where they are, and their totals go to them."""
    way = ({"m": F.avg, "s": F.stddev_samp}, lambda x, t: _score(x, t("m"), t("s")), "zscore")
    if not by:
        return _scaled(df, columns, *way)
    large, rest = by_size(df, by)
    w = Window.partitionBy(*by)
    return _scaled(large, columns, *way, by=by).union(rest.withColumns({f"{c}_zscore": _score(_q(c), F.avg(_q(c)).over(w), F.stddev_samp(_q(c)).over(w)) for c in columns}))


def _score(x: Column, centre: Column, width: Column) -> Column:
    return F.coalesce(F.try_divide(x - centre, F.nullif(width, F.lit(0.0))), F.lit(0.0))


def _scaled(df, columns, totals, formula, suffix, by=()) -> DataFrame:
    one = df.groupBy(*by).agg(*[f(_q(c)).alias(f"__{c}_{n}") for c in columns for n, f in totals.items()])  # a row for each group
    return _apply(df, one, columns, formula, suffix, list(by))


def _apply(df, one, columns, formula, suffix, by) -> DataFrame:
    made = {f"{c}_{suffix}": formula(_q(c), lambda n, c=c: F.col(f"`__{c}_{n}`")) for c in columns}
    return _match(df, one, by).withColumns(made).drop(*[c for c in one.columns if c not in by])


def normalize(df: DataFrame, columns: list[str], way: str = "zscore", exact: bool = True) -> DataFrame:
    """df with ``{c}_normalized``: zscore, minmax or robust (median and quartiles); 0 where the column has no spread. Without ``exact`` quartiles are of a sketch of bounded size."""
    if way == "zscore":
        return _scaled(df, columns, {"m": F.avg, "s": F.stddev_samp}, lambda x, t: _score(x, t("m"), t("s")), "normalized")
    if way == "minmax":
        return _scaled(df, columns, {"lo": F.min, "hi": F.max}, lambda x, t: _score(x, t("lo"), t("hi") - t("lo")), "normalized")
    if way == "robust":
        points = (0.25, 0.5, 0.75)
        score = lambda x, t: _score(x, t("q")[1], t("q")[2] - t("q")[0])
        if exact:
            return _apply(df, _quantiles(df, columns, points), columns, score, "normalized", [])
        return _scaled(df, columns, {"q": lambda x: F.percentile_approx(x, list(points), 10_000)}, score, "normalized")
    raise ValueError(f"no such way: {way}")


def distribution(df: DataFrame, columns: list[str], by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Pearson's median skewness over three, and the spread of the 5th to 95th percentile, both in standard deviations; and the moments themselves."""
    points, by = (0.05, 0.5, 0.95), list(by or [])
    moments = []
    for c in columns:
        moments += [F.avg(_q(c)).alias(f"__{c}_m"), F.stddev_samp(_q(c)).alias(f"__{c}_s"), F.kurtosis(_q(c)).alias(f"__{c}_k")]
        if not exact:
            moments.append(F.percentile_approx(_q(c), list(points), 10_000).alias(f"__{c}_q"))
    if not exact:
        out = df.groupBy(*by).agg(*moments)
    elif not by:
        out = df.agg(*moments).crossJoin(F.broadcast(_quantiles(df, columns, points)))
    else:
        large, rest = by_size(df, by)
        exactly = [F.percentile(_q(c), F.array(*map(F.lit, points))).alias(f"__{c}_q") for c in columns]
        out = _match(large.groupBy(*by).agg(*moments), quantiles(large, {f"__{c}_q": _q(c) for c in columns}, points, by), by).unionByName(rest.groupBy(*by).agg(*moments, *exactly))
    made = []
    for c in columns:
        m, width, k, p = (F.col(f"`__{c}_{n}`") for n in "mskq")
        made += [_score(m, p[1], width).alias(f"{c}_skewness"), _score(p[2], p[0], width).alias(f"{c}_kurtosis"), k.alias(f"{c}_kurtosis_moment")]
    return out.select(*by, *made)
