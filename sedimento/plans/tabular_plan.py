"""Table queries over lineitem and their SQL. Gaps and outliers are put in by the same rule on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimento.operators import tabular as B
from sedimento.session import table


def _items(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    gap = (F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0
    return x.select(
        "l_orderkey", "l_linenumber", F.when(~gap, F.col("l_quantity")).alias("q"), F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 != 0, F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_orderkey") % 97 == 0, F.col("l_extendedprice") * 50).otherwise(F.col("l_extendedprice")).alias("price"), "l_discount", "l_linestatus",
    )


def _six(c: str) -> Column:
    return (F.round(c, 6) + F.lit(0.0)).alias(c)


def missing_count(spark: SparkSession, d: str) -> DataFrame:
    return B.missing_counts(_items(spark, d), ["q", "flag", "price"])


def missing_mean(spark: SparkSession, d: str) -> DataFrame:
    return B.fill_missing(_items(spark, d), ["q"], "mean").select("l_orderkey", "l_linenumber", _six("q"))


def missing_median(spark: SparkSession, d: str) -> DataFrame:
    return B.fill_missing(_items(spark, d), ["q"], "median").select("l_orderkey", "l_linenumber", "q")


def missing_constant(spark: SparkSession, d: str) -> DataFrame:
    return B.fill_missing(_items(spark, d), ["q", "flag"], "constant", -1).select("l_orderkey", "l_linenumber", "q", "flag")


def missing_mode(spark: SparkSession, d: str) -> DataFrame:
    return B.fill_missing(_items(spark, d), ["flag"], "mean").select("l_orderkey", "l_linenumber", "flag")


def missing_drop(spark: SparkSession, d: str) -> DataFrame:
    return B.fill_missing(_items(spark, d), ["q", "flag"], "drop").select("l_orderkey", "l_linenumber", "q", "flag")


def outliers_iqr(spark: SparkSession, d: str) -> DataFrame:
    return B.clip_outliers(_items(spark, d), ["price"], "iqr").select("l_orderkey", "l_linenumber", _six("price"), "price_outlier")


def outliers_zscore(spark: SparkSession, d: str) -> DataFrame:
    return B.clip_outliers(_items(spark, d), ["price"], "zscore").select("l_orderkey", "l_linenumber", F.round("price", 3).alias("price"), "price_outlier")


def normalize_minmax(spark: SparkSession, d: str) -> DataFrame:
    return B.normalize(_items(spark, d), ["price"]).select("l_orderkey", "l_linenumber", _six("price"))


def normalize_zscore(spark: SparkSession, d: str) -> DataFrame:
    return B.normalize(_items(spark, d), ["q"], "zscore", ["l_linestatus"]).select("l_orderkey", "l_linenumber", _six("q"))


def tabular_quality(spark: SparkSession, d: str) -> DataFrame:
    return B.table_quality(_items(spark, d), ["q", "flag", "l_discount"])


def clean_tabular(spark: SparkSession, d: str) -> DataFrame:
    return B.clean_table(_items(spark, d).select("q", "flag", "l_linestatus"))


QUERIES = {f.__name__: f for f in (missing_count, missing_mean, missing_median, missing_constant, missing_mode, missing_drop, outliers_iqr, outliers_zscore, normalize_minmax, normalize_zscore, tabular_quality, clean_tabular)}

_I = """i as (select l_orderkey, l_linenumber, case when (l_orderkey + l_linenumber) % 7 <> 0 then l_quantity end as q, case when (l_orderkey + l_linenumber) % 11 <> 0 then l_returnflag end as flag,
    case when l_orderkey % 97 = 0 then l_extendedprice * 50 else l_extendedprice end as price, l_discount, l_linestatus from lineitem)"""
SQL = {
    "missing_count": f"with {_I} select 'q' as column_name, count(*) filter (where q is null)::bigint as missing, count(*)::bigint as total from i union all select 'flag', count(*) filter (where flag is null), count(*) from i union all select 'price', count(*) filter (where price is null), count(*) from i",
    "missing_mean": f"with {_I} select l_orderkey, l_linenumber, round(coalesce(q, (select avg(q) from i)), 6) + 0.0::double as q from i",
    "missing_median": f"with {_I} select l_orderkey, l_linenumber, coalesce(q, (select median(q) from i)) as q from i",
    "missing_constant": f"with {_I} select l_orderkey, l_linenumber, coalesce(q, -1)::double as q, coalesce(flag, '-1') as flag from i",
    "missing_mode": f"with {_I}, m as (select flag, count(*) as n from i where flag is not null group by 1) select l_orderkey, l_linenumber, coalesce(flag, (select min(flag) from m where n = (select max(n) from m))) as flag from i",
    "missing_drop": f"with {_I} select l_orderkey, l_linenumber, q, flag from i where q is not null and flag is not null",
    "outliers_iqr": f"""with {_I}, s as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.75) as b from i), f as (select a - 1.5 * (b - a) as lo, b + 1.5 * (b - a) as hi from s)
        select l_orderkey, l_linenumber, round(greatest(least(price, hi), lo), 6) + 0.0::double as price, price < lo or price > hi as price_outlier from i, f""",
    "outliers_zscore": f"""with {_I}, s as (select avg(price) as m, stddev_samp(price) as sd from i), f as (select m - 3 * sd as lo, m + 3 * sd as hi from s)
        select l_orderkey, l_linenumber, round(greatest(least(price, hi), lo), 3) as price, price < lo or price > hi as price_outlier from i, f""",
    "normalize_minmax": f"with {_I}, s as (select min(price) as a, max(price) as b from i) select l_orderkey, l_linenumber, round((price - a) / (b - a), 6) + 0.0::double as price from i, s",
    "normalize_zscore": f"with {_I}, s as (select l_linestatus as k, avg(q) as m, stddev_samp(q) as sd from i group by 1) select l_orderkey, l_linenumber, round((q - m) / sd, 6) + 0.0::double as q from i join s on k = l_linestatus",
    "tabular_quality": f"""with {_I}, s as (select count(*) as n, count(*) filter (where q is null) + count(*) filter (where flag is null) + count(*) filter (where l_discount is null) as m from i), u as (select count(*) as k from (select distinct q, flag, l_discount from i))
        select 'missing_values' as issue, m / (n * 3)::double as confidence from s where m / (n * 3)::double > 0.1 union all select 'duplicate_rows', (n - k)::double / n from s, u where n > k""",
    "clean_tabular": f"with {_I} select distinct coalesce(q, 0)::double as q, coalesce(flag, '0') as flag, l_linestatus from i",
}
