"""Table cleaning: missing values, outliers, normalisation, table quality.

A table is one frame, or many files in one frame told apart by `by` columns. Null and NaN are missing. Statistics of a
whole frame are one aggregate row and enter the second pass as literals; statistics of files are joined on `by`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, FEW = 4096, 20_000


def known(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN as null in the given columns."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns if kinds[c] in ("double", "float")}) if columns else df


def exact_quantiles(df: DataFrame, column: str, levels: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation, exact at any size.

    The range that holds a rank is cut into BINS bins and counted, again and again, until it holds at most FEW rows or
    one value: each pass gives the driver BINS counts, and no task ever holds or sorts a column.
    """
    x = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = x.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(levels)

    def at(rank: int) -> float:
        a, b, below = low, high, 0
        while a < b:
            step = (b - a) / BINS
            inside = x.where((F.col("v") >= a) & (F.col("v") <= b))
            if step <= 0 or a + step == a:
                break
            counts = inside.groupBy(F.least(F.floor((F.col("v") - F.lit(a)) / F.lit(step)), F.lit(BINS - 1)).alias("k")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
            for r in sorted(counts):
                if below + r["c"] > rank:
                    a, b, here = r["a"], r["b"], r["c"]
                    break
                below += r["c"]
            if a < b and here <= FEW:
                return sorted(r[0] for r in x.where((F.col("v") >= a) & (F.col("v") <= b)).limit(here).collect())[rank - below]
        return a

    out = []
    for q in levels:
        k = q * (n - 1)
        first = at(math.floor(k))
        second = first if k == math.floor(k) else at(math.ceil(k))
        out.append(first + (second - first) * (k - math.floor(k)))
    return out


def mode(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """by..., mode: the most frequent value, the smallest of equally frequent ones."""
    per = df.where(F.col(column).isNotNull()).groupBy(*(by or []), F.col(column).alias("value")).agg(F.count("*").alias("n"))
    top = per.groupBy(*(by or [])).agg(F.max("n").alias("most")) if by else None
    if by:
        return per.join(top, by).where("n = most").groupBy(*by).agg(F.min("value").alias("mode"))
    most = per.agg(F.max("n")).first()[0]
    return per.where(F.col("n") == F.lit(most)).agg(F.min("value").alias("mode"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, missing, total of each column, in one pass."""
    x = known(df, columns).agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing"), F.col("total")) for c in columns])
    return x.select(F.explode(parts).alias("p")).select("p.*")


def fill_missing(df: DataFrame, columns: list[str], strategy: str = "mean", fill_value: object = 0) -> DataFrame:
    """The table without missing values in the given columns.

    mean and median fill numbers; other columns get their mode (the smallest of ties). constant fills with fill_value
    where the type allows, drop removes rows. A column that is all missing gets fill_value.
    """
    x = known(df, columns)
    if strategy == "drop":
        return x.dropna(subset=columns)
    kinds = dict(x.dtypes)
    number = [c for c in columns if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    values: dict[str, object] = {}
    if strategy == "mean" and number:
        values |= {c: v for c, v in zip(number, x.agg(*[F.avg(c) for c in number]).first(), strict=True) if v is not None}
    elif strategy == "median":
        values |= {c: v for c in number if (v := exact_quantiles(x, c, [0.5])[0]) is not None}
    if strategy != "constant":
        values |= {c: v for c in columns if c not in number and (v := mode(x, c).first()[0]) is not None}
    fill = lambda c: F.lit(values.get(c, fill_value if c in number else str(fill_value)))
    return x.withColumns({c: F.coalesce(F.col(c).cast("double") if c in number and strategy in ("mean", "median") else F.col(c), fill(c).cast("double" if c in number and strategy in ("mean", "median") else kinds[c])) for c in columns})


def fences(df: DataFrame, column: str, method: str = "iqr", threshold: float = 3.0) -> tuple[float, float] | None:
    """Lower and upper fence: quartiles -/+ 1.5 IQR, or mean -/+ threshold sample deviations; None if there is no spread."""
    if method == "iqr":
        q1, q3 = exact_quantiles(df, column, [0.25, 0.75])
        return None if q1 is None or q3 == q1 else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    mean, sd = known(df, [column]).agg(F.avg(column), F.stddev_samp(column)).first()
    return None if not sd or math.isnan(sd) else (mean - threshold * sd, mean + threshold * sd)


def clip_outliers(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """The table with <column>_outlier flags and values clipped to the fences; missing values are never flagged."""
    x = known(df, columns)
    for c in columns:
        f = fences(x, c, method, threshold)
        low, high = f if f else (None, None)
        out = F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False)) if f else F.lit(False)
        x = x.withColumn(f"{c}_outlier", out).withColumn(c, F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low))) if f else F.col(c))
    return x


def normalize(df: DataFrame, columns: list[str], method: str = "minmax", by: list[str] | None = None) -> DataFrame:
    """minmax to 0..1 or zscore with the sample deviation; constant columns become 0.0 (missing values too).

    A single row has no deviation: its zscore is null. Values that are missing stay so in other columns.
    """
    x = known(df, columns)
    agg = {"minmax": lambda c: [F.min(c).alias(f"{c}__a"), F.max(c).alias(f"{c}__b")], "zscore": lambda c: [F.avg(c).alias(f"{c}__a"), F.stddev_samp(c).alias(f"{c}__b")]}[method]
    stats = [a for c in columns for a in agg(c)]
    if by:
        x = x.join(x.groupBy(*by).agg(*stats), by)
        get = F.col
    else:
        row = x.agg(*stats).first()
        get = lambda c: F.lit(row[c]).cast("double")

    def scaled(c: str) -> Column:
        a, b = get(f"{c}__a"), get(f"{c}__b")
        if method == "minmax":
            return F.when(a == b, 0.0).otherwise((F.col(c) - a) / F.nullif(b - a, F.lit(0.0)))
        return F.when(b == 0, 0.0).otherwise((F.col(c) - a) / F.nullif(b, F.lit(0.0)))

    return x.withColumns({c: scaled(c) for c in columns}).drop(*[f"{c}__{k}" for c in columns for k in "ab"] if by else [])


def table_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """issue, confidence: missing values above a tenth of the cells; repeated rows (the first is kept)."""
    x = known(df, columns).select(*columns)
    rows, missing = x.agg(F.count("*"), sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))).first()
    distinct = x.distinct().count()
    share, dups = missing / max(rows * len(columns), 1), rows - distinct
    found = [("missing_values", min(1.0, share))] * (share > 0.1) + [("duplicate_rows", min(1.0, dups / max(rows, 1)))] * (dups > 0)
    return df.sparkSession.createDataFrame(found, "issue string, confidence double")


def clean_table(df: DataFrame, fill_value: object = 0) -> DataFrame:
    """Missing values filled, then repeated rows dropped."""
    return fill_missing(df, df.columns, "constant", fill_value).dropDuplicates()
