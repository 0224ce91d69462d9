"""Correlations with p-values, calibration, and fixed-effects regression with cluster-robust errors.

Everything is built from counts, means and central cross products, which Spark merges stably from partial aggregates. Constant
columns and single rows give nulls, never an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterloom.functions.special import correlation_p_value, normal_p_value, normal_two_sided
from quarterloom.session import cut_lineage

#: Time periods of a two-way fit, whose square matrix is solved on the driver.
MOST_PERIODS = 2000


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson's r over rows with both values; null where either is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0)))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within a group, ties sharing the mean of their places."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)).cast("double") + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def correlations(df: DataFrame, by: str, x: str, y: str, raw: str, least: int = 12) -> DataFrame:
    """Per entity the Pearson correlation of x with y, Spearman's of x with raw, their p-values, mean and median of raw.

    The rows of an entity are its quarters, a short list by nature; ranks are windows over them.
    """
    rows = df.dropna(subset=[by, x, y, raw]).withColumns({"__rx": average_rank(x, [by]), "__ry": average_rank(raw, [by])})
    out = rows.groupBy(by).agg(
        F.count("*").alias("n_quarters"), correlation(x, y).alias("pearson_r"), correlation("__rx", "__ry").alias("spearman_rho"),
        F.avg(raw).alias("mean_growth"), F.expr(f"percentile(`{raw}`, 0.5D)").alias("median_growth"),
    ).where(F.col("n_quarters") >= least)
    return out.withColumns({"pearson_p": correlation_p_value("pearson_r", "n_quarters"), "spearman_p": correlation_p_value("spearman_rho", "n_quarters")})


def calibration(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row with slope, intercept and correlation of y on x."""
    slope = F.try_divide(F.covar_pop(x, y), F.nullif(F.var_pop(F.when(F.col(y).isNotNull(), F.col(x))), F.lit(0.0)))
    means = [F.avg(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c))) for c in (x, y)]
    one = df.agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), slope.alias("slope"), means[0].alias("__mx"), means[1].alias("__my"), correlation(x, y).alias("corr"))
    return one.select("n", "slope", (F.col("__my") - F.col("slope") * F.col("__mx")).alias("intercept"), "corr")


def slope_by(df: DataFrame, y: str, x: str, entity: str, by: list[str] | None = None, cluster_is_entity: bool = True) -> DataFrame:
    """A13 with one regressor, lazily and for many groups at once: slope, standard error, t, p, n, entities.

    Errors are clustered by entity. The score of a cluster is its cross product less slope times its square, so two
    aggregations suffice and nothing is demeaned row by row.
    """
    by = by or []
    rows = df.dropna(subset=[*by, entity, y, x])
    cells = rows.groupBy(*by, entity).agg(F.count("*").cast("double").alias("n"), (F.covar_pop(x, y) * F.count("*")).alias("xy"), (F.var_pop(x) * F.count("*")).alias("xx")).withColumn("__one", F.lit(1))
    keys = [*by, "__one"]
    fits = cells.groupBy(*keys).agg(F.try_divide(F.sum("xy"), F.nullif(F.sum("xx"), F.lit(0.0))).alias("beta"), F.sum("xx").alias("sxx"), F.sum("n").alias("rows"), F.count("*").cast("double").alias("entities"))
    scored = cells.join(fits, keys).groupBy(*keys).agg(F.first("beta").alias("beta"), F.first("sxx").alias("sxx"), F.first("rows").alias("rows"), F.first("entities").alias("entities"), F.sum(F.pow(F.col("xy") - F.col("beta") * F.col("xx"), F.lit(2.0))).alias("meat"))
    factor = F.try_divide(F.col("entities"), F.nullif(F.col("entities") - 1, F.lit(0.0))) * F.try_divide(F.col("rows") - 1, F.nullif(F.col("rows") - 1 - F.col("entities"), F.lit(0.0)))
    se = F.sqrt(F.when(factor > 0, factor * F.col("meat"))) / F.nullif(F.col("sxx"), F.lit(0.0))
    out = scored.withColumn("se", se).withColumn("t", F.try_divide(F.col("beta"), F.nullif(F.col("se"), F.lit(0.0))))
    return out.select(*by, F.col("rows").cast("bigint").alias("n"), F.col("entities").cast("bigint").alias("entities"), "beta", "se", "t", normal_p_value("t").alias("p"))


_SUMS = "what string, a string, b string, v double"


def _cells(df: DataFrame, columns: list[str], entity: str, time: str | None) -> DataFrame:
    """One row per entity with the list of its periods: period, and in one array the count, the means, and the central products of the columns."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    values = F.array(F.count("*").cast("double"), *(F.avg(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) * F.count("*") for i, j in pairs))
    keys = [F.col(entity).alias("entity"), (F.col(time).cast("string") if time else F.lit(None).cast("string")).alias("period")]
    # At most one cell per period in each list.
    return df.groupBy(*keys).agg(values.alias("v")).groupBy("entity").agg(F.collect_list(F.struct("period", "v")).alias("cells")).select("cells")


def _entities(batches: Iterator[pa.RecordBatch], k: int, timed: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(periods, counts, means less the entity's, central products) of each entity; if timed, of its cells with a period."""
    upper = np.triu_indices(k)
    for batch in batches:
        for cells in batch.column("cells").to_pylist():
            used = [c for c in cells if not timed or c["period"] is not None]
            if used:
                v = np.array([c["v"] for c in used])
                n, means, inner = v[:, 0], v[:, 1 : k + 1], np.zeros((k, k))
                inner[upper] = v[:, k + 1 :].sum(axis=0)
                inner.T[upper] = inner[upper]
                yield [c["period"] for c in used], n, means - (n @ means) / n.sum(), inner


def _sum_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["what", "a", "b", "v"])


def _products(k: int, timed: bool):
    """Adds up, per task, the cross products of the columns, and what the periods share through the entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size, entities = np.zeros((k, k)), 0.0, 0
        known: dict[str, int] = {}
        square, sums = np.zeros((0, 0)), np.zeros((0, k))
        for periods, n, means, inner in _entities(batches, k, timed):
            total += inner + (means * n[:, None]).T @ means
            size, entities = size + n.sum(), entities + 1
            if timed:
                at = np.array([known.setdefault(t, len(known)) for t in periods])
                if len(known) > MOST_PERIODS:
                    raise ValueError(f"more than {MOST_PERIODS} periods; a two-way fit takes no more")
                if len(known) > len(square):
                    grown = np.zeros((2 * len(known), 2 * len(known)))
                    grown[: len(square), : len(square)] = square
                    square, sums = grown, np.vstack([sums, np.zeros((2 * len(known) - len(sums), k))])
                square[np.ix_(at, at)] += np.diag(n) - np.outer(n, n) / n.sum()
                sums[at] += n[:, None] * means
        rows = [("size", "", "", float(size)), ("entities", "", "", float(entities))]
        rows += [("total", str(i), str(j), float(total[i, j])) for i in range(k) for j in range(k)]
        names = list(known)
        rows += [("square", names[i], names[j], float(square[i, j])) for i, j in zip(*np.nonzero(square), strict=True)]
        rows += [("sums", name, str(j), float(sums[i, j])) for i, name in enumerate(names) for j in range(k)]
        yield _sum_rows(rows)

    return run


def _scores(k: int, effects: dict[str, np.ndarray] | None, fits: dict[str, tuple[int, list[int], np.ndarray]]):
    """Adds up, per task, the outer products of the entities' scores for each fit (y, xs, coefficients)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meat = {name: np.zeros((len(xs), len(xs))) for name, (_, xs, _) in fits.items()}
        for periods, n, means, inner in _entities(batches, k, effects is not None):
            if effects is not None:
                shift = np.array([effects[t] for t in periods])
                means = means - shift + (n @ shift) / n.sum()
            own = inner + (means * n[:, None]).T @ means
            for name, (y, xs, beta) in fits.items():
                score = own[xs, y] - own[np.ix_(xs, xs)] @ beta
                meat[name] += np.outer(score, score)
        yield _sum_rows([(name, str(i), str(j), float(m[i, j])) for name, m in meat.items() for i in range(len(m)) for j in range(len(m))])

    return run


def fe_fits(df: DataFrame, models: dict[str, tuple[str, list[str]]], entity: str, times: dict[str, str | None]) -> DataFrame:
    """OLS with entity (and time) effects, errors clustered by entity, for several models on the same rows.

    models: name -> (outcome, regressors). times: label -> time column of a two-way fit, or None (one time column at most). One row per
    model, label and regressor: model, effects, term, coef, se, t, p (normal), n, entities, r2_within. The small-sample factor counts every
    dummy. Rows count if every column of every model is present, in two-way fits the period too.

    The rows are reduced once to a list of periods per entity; two passes over these lists serve all models: one for the cross products
    and the periods' equations (one unknown per period, solved on the driver), one for the scores.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for y, xs in models.values() for c in (y, *xs)))
    time = next((t for t in times.values() if t), None)
    rows = df.dropna(subset=[entity, *columns]).select(entity, *([time] if time else []), *(F.col(c).cast("double").alias(c) for c in columns))
    lists = cut_lineage(_cells(rows, columns, entity, time))
    k, out = len(columns), []
    for label, own in times.items():
        add = lambda run: lists.mapInArrow(run, _SUMS).groupBy("what", "a", "b").agg(F.sum("v").alias("v")).collect()
        parts: dict[str, dict[tuple[str, str], float]] = {}
        for r in add(_products(k, own is not None)):
            parts.setdefault(r.what, {})[r.a, r.b] = r.v
        n, groups = int(parts["size"]["", ""]) if "size" in parts else 0, int(parts["entities"]["", ""]) if "size" in parts else 0
        if not n:
            continue
        m = np.array([[parts["total"][str(i), str(j)] for j in range(k)] for i in range(k)])
        effects, names = None, sorted({a for a, _ in parts.get("sums", {})})
        if own is not None:
            at = {name: i for i, name in enumerate(names)}
            square, sums = np.zeros((len(names), len(names))), np.zeros((len(names), k))
            for (a, b), v in parts.get("square", {}).items():
                square[at[a], at[b]] = v
            for (a, b), v in parts["sums"].items():
                sums[at[a], int(b)] = v
            solved = np.linalg.pinv(square, hermitian=True) @ sums
            m = m - sums.T @ solved
            effects = dict(zip(names, solved, strict=True))
        fits, inverses = {}, {}
        for name, (y, xs) in models.items():
            yi, xi = columns.index(y), [columns.index(x) for x in xs]
            inverses[name] = np.linalg.pinv(m[np.ix_(xi, xi)], hermitian=True)
            fits[name] = (yi, xi, inverses[name] @ m[xi, yi])
        meats = {name: np.zeros((len(xs), len(xs))) for name, (_, xs) in models.items()}
        for r in add(_scores(k, effects, fits)):
            meats[r.what][int(r.a), int(r.b)] = r.v
        for name, (yi, xi, beta) in fits.items():
            free = n - (len(xi) + groups + max(0, len(names) - 1))
            factor = groups / (groups - 1) * (n - 1) / free if groups > 1 and free > 0 else float("nan")
            errors = np.sqrt(np.maximum(np.diag(inverses[name] @ meats[name] @ inverses[name]), 0)) * math.sqrt(factor) if factor == factor else np.full(len(xi), np.nan)
            r2 = float(beta @ m[xi, yi] / m[yi, yi]) if m[yi, yi] > 0 else None
            for term, b, e in zip(models[name][1], beta, errors, strict=True):
                t = float(b / e) if e > 0 else None
                out.append((name, label, term, float(b), float(e) if e == e else None, t, normal_two_sided(t) if t is not None else None, n, groups, r2))
    return spark.createDataFrame(out, "model string, effects string, term string, coef double, se double, t double, p double, n bigint, entities bigint, r2_within double")


def fe_fit(df: DataFrame, y: str, xs: list[str], entity: str, time: str | None = None) -> DataFrame:
    """One fit. One row per regressor: term, coef, se, t, p, n, entities, r2_within."""
    return fe_fits(df, {"": (y, xs)}, entity, {"": time}).drop("model", "effects")


def median_split(df: DataFrame, value: str, by: str) -> DataFrame:
    """Mean of value over rows at or above the median of another column, and below."""
    middle = df.agg(F.expr(f"percentile(`{by}`, 0.5D)").alias("__m")).withColumn("__one", F.lit(1))
    rows = df.withColumn("__one", F.lit(1)).join(F.broadcast(middle), "__one")
    high = F.col(by) >= F.col("__m")
    return rows.agg(F.avg(F.when(high, F.col(value))).alias("mean_high"), F.avg(F.when(~high, F.col(value))).alias("mean_low"))


def finite(value: float) -> float | None:
    return value if math.isfinite(value) else None
