"""References to records that do not exist, are deleted, or arrive later.

Parents are cut into ranges of RANGE_WIDTH keys and kept as one sorted array a range; batches of references are probed
by binary search. A range with more than refs_a_task references (a hot parent) is split: its references are spread over
parts and its bounded array is copied to each. Which ranges are hot is a small joined frame, not a condition in the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimento.operators.ranking import HOT_ROWS, copied, hot_keys, salted

RANGE_WIDTH = 16_384
KINDS = ("missing", "deleted", "late")


@dataclass(frozen=True)
class Reference:
    """Rows of `child` (id, ref, at: time of the referring row) that refer to rows of `parent` (id, deleted, created_at)."""

    table_name: str
    field_name: str
    child: DataFrame
    parent: str


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    order = np.argsort(parents["id"].to_numpy(), kind="stable")
    keys = parents["id"].to_numpy()[order]
    deleted = np.asarray(parents["deleted"].to_pylist(), dtype=bool)[order]
    created = parents["created"].to_numpy()[order]  # -2^63 where null
    ref = refs["ref"].to_numpy()
    at = np.searchsorted(keys, ref)
    near = np.minimum(at, max(len(keys) - 1, 0))
    hit = (at < len(keys)) & (keys[near] == ref) if len(keys) else np.zeros(len(ref), bool)
    time = refs["at"].to_numpy()  # 2^63-1 where null
    if len(keys):
        kind = np.where(~hit, 0, np.where(deleted[near], 1, np.where(created[near] > time, 2, -1)))
    else:
        kind = np.zeros(len(ref), int)
    bad = np.flatnonzero(kind >= 0)
    part = refs.take(pa.array(bad))
    return pa.table({"rel": part["rel"], "record_id": part["record_id"], "at": part["at"], "kind": pa.array(kind[bad].astype("int32"))})


def orphans(references: list[Reference], parents: dict[str, DataFrame], refs_a_task: int = HOT_ROWS) -> DataFrame:
    """table_name, field_name, record_id, orphan_kind, at: references that do not hold.

    Null and 0 are no reference. Kinds, first that applies: `missing` (no row has that id), `deleted`, `late` (the
    target's created_at is after the referring row's time, both known). One row for each record id and kind, however
    often the record is repeated; `at` is then its earliest time (null if unknown). Parents with repeated ids count as
    deleted if any copy is, and as created at their earliest time. Empty tables: all references are missing.
    """
    names = list(parents)
    low, high = -(1 << 63), (1 << 63) - 1
    keys = None
    for k, name in enumerate(names):
        one = (
            parents[name].where("id is not null").groupBy("id").agg(F.max(F.coalesce("deleted", F.lit(False))).alias("deleted"), F.min("created_at").alias("created_at"))
            .select(F.lit(k).alias("side"), "id", "deleted", F.coalesce(F.unix_micros("created_at"), F.lit(low)).alias("created"))
        )
        keys = one if keys is None else keys.unionByName(one)
    refs = None
    for k, r in enumerate(references):
        one = r.child.where("ref is not null and ref <> 0 and id is not null").select(
            F.lit(k).alias("rel"), F.lit(names.index(r.parent)).alias("side"), F.col("id").alias("record_id"), "ref", F.coalesce(F.unix_micros("at"), F.lit(high)).alias("at")
        )
        refs = one if refs is None else refs.unionByName(one)
    span = lambda c: F.shiftright(F.col(c), RANGE_WIDTH.bit_length() - 1)
    refs, keys = refs.withColumn("span", span("ref")), keys.withColumn("span", span("id"))
    place = ["side", "span"]
    hot = hot_keys(refs, place, refs_a_task)
    refs, keys = salted(refs, hot, place, "record_id"), copied(keys, hot, place)
    by = [*place, "salt__"]
    bad = refs.groupBy(*by).cogroup(keys.groupBy(*by)).applyInArrow(_probe, "rel int, record_id long, at long, kind int")
    label = lambda what: F.element_at(F.array(*[F.lit(x) for x in what]), F.col("rel") + 1)
    return bad.groupBy("rel", "record_id", "kind").agg(F.min("at").alias("at")).select(
        label([r.table_name for r in references]).alias("table_name"), label([r.field_name for r in references]).alias("field_name"), "record_id",
        F.element_at(F.array(*[F.lit(x) for x in KINDS]), F.col("kind") + 1).alias("orphan_kind"), F.timestamp_micros(F.when(F.col("at") < high, F.col("at"))).alias("at"),
    )


def catalog_orphans(samples: DataFrame, datasets: DataFrame, tasks: DataFrame, suggestions: DataFrame, logs: DataFrame) -> DataFrame:
    """The references of the catalog: suggestions to samples, samples to datasets, log lines to tasks."""
    gone = F.coalesce(F.lower(F.trim("status")) == "deleted", F.lit(False))
    parents = {
        "samples": samples.select("id", gone.alias("deleted"), "created_at"),
        "datasets": datasets.select("id", (gone | F.coalesce("is_deleted", F.lit(False))).alias("deleted"), "created_at"),
        "tasks": tasks.select("id", F.lit(False).alias("deleted"), "created_at"),
    }
    ref = lambda df, field, at: df.select("id", F.col(field).alias("ref"), F.col(at).alias("at"))
    return orphans(
        [
            Reference("cleaning_suggestions", "sample_id", ref(suggestions, "sample_id", "created_at"), "samples"),
            Reference("cleaning_suggestions", "output_sample_id", ref(suggestions, "output_sample_id", "updated_at"), "samples"),
            Reference("samples", "dataset_id", ref(samples, "dataset_id", "created_at"), "datasets"),
            Reference("task_logs", "task_id", ref(logs, "task_id", "created_at"), "tasks"),
        ],
        parents,
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per table, field, kind and month of the referring row (null month: time unknown)."""
    return found.groupBy("table_name", "field_name", "orphan_kind", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))
