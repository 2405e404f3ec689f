"""Sample matching target category proportions: mergeable per-category reservoirs in one pass, then a uniform trim.

Each task keeps, for each target category, rows with the smallest seeded priorities (bottom-k) and counts what it saw.
Reservoirs merge by union, as the bottom-k of a union lies in the union of the bottom-k. A category's capacity is its
largest possible quota, known before the pass from the number of rows; a task that saw a part f of all rows keeps its
part of the capacity and some slack. What a task left out is counted, so after the pass it is known whether any of it
could have been drawn: only then (categories gathered in few tasks) their rows below a safe priority are read again.

The merged reservoirs tell which categories are exhausted, and are trimmed uniformly to feasible quotas: first by a
histogram of priorities, then by rank in the one bucket that is cut, so no category is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.session import cut

DRAW_FRACTION = 10  # the draw is a tenth of the active samples
BUCKETS, SHIFT = 4096, 51  # of 63-bit priorities


def _targets(targets: DataFrame, limit: int = 10_000) -> list:
    """The target table as rows, ordered; it is a small fixed table and more than `limit` rows are refused."""
    rows = targets.where("modality is not null and class_name is not null").orderBy("modality", "class_name", "class_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} target categories")
    return rows


def _category(rows: list, modality: Column, named: Column) -> Column:
    """Index of a sample's category in rows, else null. A class without a name is looked up by its id."""
    one = lambda pairs, key: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key] if pairs else F.lit(None).cast("int")
    word = lambda s: "_".join(s.strip().lower().replace("-", " ").replace("_", " ").split())
    by_name = {f"{word(r['modality'])}/{word(r['class_name'])}": k for k, r in enumerate(rows)}
    by_id = {f"{word(r['modality'])}/{r['class_id']}": k for k, r in enumerate(rows) if r["class_id"] is not None}
    return F.when(named["name"].isNotNull(), one(by_name, F.concat_ws("/", modality, named["name"]))).otherwise(one(by_id, F.concat_ws("/", modality, named["id"].cast("string"))))


def _room(capacity: int, part: float) -> int:
    """How many of the `capacity` smallest priorities a task with this part of the rows holds, but for rare cases."""
    return int(min(capacity, np.ceil(capacity * part + 6 * np.sqrt(capacity * part) + 50)))


def _reservoirs(capacity: list[int], total: int):
    """Rows (category, id, priority) -> kept rows (category, id, priority), and for each category that the task saw a row
    (category, rows seen, greatest kept priority or null if all are kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(capacity)
        seen = np.zeros(n + 1, np.int64)  # the last is for rows of no category
        kept: list[list] = [[] for _ in range(n)]
        size = [0] * n

        def trim(k: int, room: int) -> None:
            ids, pr = (np.concatenate(x) for x in zip(*kept[k], strict=True))
            if len(ids) > room:
                at = np.argpartition(pr, room - 1)[:room] if room else np.zeros(0, int)
                ids, pr = ids[at], pr[at]
            kept[k], size[k] = [(ids, pr)], len(ids)

        for b in batches:
            cat = b.column(0).fill_null(n).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, pr = b.column(1).to_numpy(), b.column(2).to_numpy()
            seen += np.bincount(cat, minlength=n + 1)
            order = np.argsort(cat, kind="stable")
            edges = np.searchsorted(cat[order], np.arange(n + 1))
            for k in range(n):
                at = order[edges[k] : edges[k + 1]]
                if len(at):
                    kept[k].append((ids[at], pr[at]))
                    size[k] += len(at)
                    if size[k] > 2 * capacity[k] + 10_000:
                        trim(k, capacity[k])
        part = seen.sum() / max(total, 1)
        for k in range(n):
            if kept[k]:
                trim(k, _room(capacity[k], part))
        most = [int(kept[k][0][1].max(initial=-1)) if k < n and size[k] < seen[k] else None for k in range(n + 1)]
        out = [(True, np.arange(n + 1), seen, pa.array(most, pa.int64()))] + [(False, np.full(size[k], k), kept[k][0][0], pa.array(kept[k][0][1], pa.int64())) for k in range(n) if kept[k]]
        for count, cat, ids, pr in out:
            yield pa.RecordBatch.from_arrays([pa.array([count] * len(cat), pa.bool_()), pa.array(cat.astype(np.int32)), pa.array(ids, pa.int64()), pr], ["is_count", "category", "id", "priority"])

    return run


def _facts(samples: DataFrame, rows: list, seed: int) -> DataFrame:
    """category (null if none), id, priority of every active sample."""
    named = reading.first_class(reading.labels(F.col("labels_json")))
    active = samples.where("id is not null and coalesce(lower(trim(status)), '') <> 'deleted'").select("id", "labels_json", reading.canonical_modality(F.col("modality")).alias("m"))
    facts = active.select("id", "m", named.alias("named"))
    return facts.select(_category(rows, F.col("m"), F.col("named")).alias("category"), "id", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 1).alias("priority"))


@dataclass
class Category:
    """What a category asks for and what the pass found of it."""

    modality: str
    class_name: str
    least: int
    share: float
    available: int = 0
    held: int = 0
    wanted: float = 0.0
    quota: int = 0
    short: bool = False


def _cuts(held: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """category -> [(bucket, rows)], buckets of priorities in order: at most BUCKETS rows a category."""
    out: dict[int, list[tuple[int, int]]] = {}
    for r in held.groupBy("category", F.shiftright("priority", SHIFT).alias("bucket")).agg(F.count("*").alias("n")).collect():
        out.setdefault(r["category"], []).append((r["bucket"], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def _last_bucket(cuts: list[tuple[int, int]], quota: int) -> int:
    """The bucket with the quota-th smallest priority."""
    for bucket, n in cuts:
        quota -= n
        if quota <= 0:
            return bucket
    return BUCKETS


def _merged(samples: DataFrame, rows: list, seed: int) -> tuple[DataFrame, list[Category], int]:
    """(category, id, priority) of merged reservoirs that hold all that can be drawn, the categories, the draw size."""
    total = samples.count()  # from the files' footers
    largest = total // DRAW_FRACTION
    cats = [Category(r["modality"], r["class_name"], int(r["min_rows"] or 0), r["target_share"] or 0.0) for r in rows]
    capacity = [max(0, int(np.ceil(c.share * largest)), c.least) for c in cats]
    facts = _facts(samples, rows, seed)
    kept = cut(facts.mapInArrow(_reservoirs(capacity, total), "is_count boolean, category int, id long, priority long"))
    told = {r["category"]: r for r in kept.where("is_count").groupBy("category").agg(F.sum("id").alias("n"), F.min("priority").alias("left_out")).collect()}
    held = kept.where("not is_count").select("category", "id", "priority")
    draw = sum(r["n"] for r in told.values()) // DRAW_FRACTION
    cuts = _cuts(held)
    again: dict[int, int] = {}
    for k, c in enumerate(cats):
        c.available = told[k]["n"] if k in told else 0
        c.held, c.wanted = sum(n for _, n in cuts.get(k, [])), c.share * draw
        c.quota = min(c.available, max(c.least, round(c.wanted)))
        left_out = told[k]["left_out"] if k in told else None
        if left_out is not None and left_out >> SHIFT <= _last_bucket(cuts.get(k, []), c.quota):
            again[k] = c.quota
    slack = 6
    while again:  # rows that a task left out may be among the quota: read those below a priority that is safe for all
        top = {k: int((1 << 63) * min(1.0, (q + slack * np.sqrt(q) + 50) / cats[k].available)) - 1 for k, q in again.items()}
        limit = F.create_map(*[F.lit(x) for kv in top.items() for x in kv])[F.col("category")]
        more = cut(facts.where(F.col("priority") <= limit))
        n = {r["category"]: r["count"] for r in more.groupBy("category").count().collect()}
        held = held.where(~F.col("category").isin(list(again))).unionByName(more)
        again = {k: q for k, q in again.items() if n.get(k, 0) < q}
        for k in top:
            cats[k].held = n.get(k, 0)
        slack *= 8
    for c in cats:  # exhausted: the reservoir, which could hold what is wanted, does not
        c.short = c.held < c.least or c.held < c.wanted
    return held, cats, draw


def draw_to_targets(samples: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(drawn, report).

    drawn: sample_id, modality, class_name: a uniform draw without replacement of each category's feasible quota: its
    target share of the draw (a tenth of the active samples, with or without a class), at least min_rows, at most what
    there is. report: modality, class_name, available, wanted, min_rows, quota, short; `short` marks exhausted
    categories: fewer rows than min_rows or than the target share asks for.

    Active samples have a status other than `deleted`. A class is that of the first classification label: class_name,
    else name, else label, in any spelling, else class_id. Other classes are in no category and only count for the size.
    Equal priorities are ordered by id; repeated rows count each time. Empty tables draw nothing; all targets are short.
    """
    spark = samples.sparkSession
    rows = _targets(targets)
    held, cats, _ = _merged(samples, rows, seed)
    schema = "category int, modality string, class_name string, available long, wanted double, min_rows long, quota long, short boolean"
    report = spark.createDataFrame([(k, c.modality, c.class_name, c.available, float(c.wanted), c.least, c.quota, c.short) for k, c in enumerate(cats)], schema)

    held = held.withColumn("bucket", F.shiftright("priority", SHIFT))
    quotas = F.broadcast(report.select("category", "modality", "class_name", "quota"))
    sizes = held.groupBy("category", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("category").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.withColumn("before", before).join(quotas, "category").select("category", "bucket", "n", (F.col("quota") - F.col("before")).alias("room"), "modality", "class_name").where("room > 0")
    chosen = held.join(room, ["category", "bucket"])
    whole = chosen.where("n <= room")
    edge = chosen.where("n > room").withColumn("r", F.row_number().over(Window.partitionBy("category", "bucket").orderBy("priority", "id"))).where("r <= room").drop("r")
    drawn = whole.unionByName(edge).select(F.col("id").alias("sample_id"), "modality", "class_name")
    return drawn, report.drop("category")


def drawn_report(samples: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """The report with `drawn`, the rows that the draw really holds, counted, in place of the quota."""
    drawn, report = draw_to_targets(samples, targets, seed)
    got = drawn.groupBy("modality", "class_name").agg(F.count("*").alias("drawn"))
    return report.join(F.broadcast(got), ["modality", "class_name"], "left").select("modality", "class_name", "available", "wanted", "min_rows", F.coalesce("drawn", F.lit(0)).alias("drawn"), "short")
