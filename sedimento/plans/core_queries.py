"""Queries of the core: name -> f(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimento.operators import flatten, hierarchy, orphans
from sedimento.plans import catalog_plan, cleaning_plan, import_plan, media_plan, tabular_plan, text_plan
from sedimento.session import table


def _placed(spark: SparkSession, d: str, intervals: bool) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.catalog_links(table(spark, d, "datasets"), table(spark, d, "samples")), intervals)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d, False).where("parent is not null")
    return p.selectExpr("g as table_name", "node as node_id", "root as root_id", "depth")


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d, True).where("depth >= 0")
    return p.selectExpr("g as table_name", "node as node_id", "root as root_id", "depth", "size as subtree_size")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d, False)
    return hierarchy.paths(p).selectExpr("g as table_name", "node as node_id", "step", "ancestor as ancestor_id")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants_by_interval(_placed(spark, d, True)).selectExpr("g as table_name", "node as node_id", "descendant as descendant_id")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.catalog_orphans(*[table(spark, d, n) for n in ("samples", "datasets", "tasks", "cleaning_suggestions", "task_logs")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "field_name", "record_id", "orphan_kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    return flatten.bridge(flatten.catalog_records(*[table(spark, d, n) for n in ("samples", "algorithms", "tasks")]))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d).where("position is not null").select("table_name", "column_name", "record_id", "path")


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    return flatten.objects(_bridge(spark, d)).selectExpr("hex(node_id) as node_id", "body", "occurrences")


def p6_regions(spark: SparkSession, d: str) -> DataFrame:
    """One of the flat tables: the regions of the label records, each with its parent record and its place there."""
    t = flatten.flat_table(_bridge(spark, d), "samples", "labels_json", "$[].regions[]")
    return t.selectExpr("record_id", "path", "parent_path", "position", "cast(region_id as bigint) as region_id", "cast(bbox[0] as bigint) as x", "cast(bbox[1] as bigint) as y", "cast(bbox[2] as bigint) as w", "cast(bbox[3] as bigint) as h")


QUERIES = {**catalog_plan.QUERIES, **tabular_plan.QUERIES, **cleaning_plan.QUERIES, **text_plan.QUERIES, **media_plan.QUERIES, **import_plan.QUERIES} | {f.__name__: f for f in (p2_found, p2_intervals, p2_paths, p2_descendants, p5_found, p5_report, p6_found, p6_objects, p6_regions)}
