"""Runs of operators: progress, log, cancel, results and their report files.

A run is driven from the driver: an operator asks its context whether to go on between the jobs it starts, and jobs of a
cancelled run are stopped through Spark's job tags. Log lines and results are rows, written in parallel as tables.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimento.registry import OperatorError, Registry

LOG = "run_id string, at double, level string, message string, payload_json string"
RESULT = "struct<model_name:string,metrics:string,summary:string,artifacts:string>"


class Cancelled(OperatorError):
    code = "CANCELLED"


@dataclass
class Run:
    """The state of one run: pending, running, then completed, failed or cancelled."""

    spark: SparkSession
    run_id: str
    status: str = "pending"
    progress: float = 0.0
    message: str = ""
    error_code: str | None = None
    lines: list[tuple] = field(default_factory=list)
    _cancel: bool = False

    def log(self, level: str, message: str, payload: dict | None = None) -> None:
        self.lines.append((self.run_id, time.time(), level, message, json.dumps(payload or {}, ensure_ascii=False)))

    def set_progress(self, progress: float, message: str = "") -> None:
        self.progress, self.message = min(100.0, max(0.0, float(progress))), message or self.message

    def is_cancel_requested(self) -> bool:
        return self._cancel

    def cancel(self) -> str:
        """A pending run is cancelled at once; of a running one the jobs are stopped, and its operator finds the request."""
        self._cancel = True
        if self.status == "pending":
            self.status = "cancelled"
            self.log("info", "Cancelled before execution")
        elif self.status == "running":
            self.message = "Cancellation requested"
            self.log("warning", self.message)
            self.spark.sparkContext.cancelJobsWithTag(self.run_id)
        return self.status

    def checkpoint(self, progress: float, message: str = "") -> None:
        """For operators, between jobs: report progress, and stop if asked to."""
        self.set_progress(progress, message)
        if self._cancel:
            raise Cancelled(self.run_id)

    def execute(self, work: Callable[[Run], DataFrame | None]) -> DataFrame | None:
        """The result of work(run); errors are kept as status, error_code and a log line."""
        if self.status != "pending":
            raise OperatorError(f"run {self.run_id} is {self.status}")
        self.status = "running"
        self.log("info", "Started")
        self.spark.sparkContext.addJobTag(self.run_id)
        try:
            out = work(self)
            if self._cancel:
                raise Cancelled(self.run_id)
            self.status, self.progress = "completed", 100.0
            self.log("info", "Completed")
            return out
        except Exception as e:  # noqa: BLE001
            self.status = "cancelled" if self._cancel else "failed"
            self.error_code = "CANCELLED" if self._cancel else getattr(e, "code", OperatorError.code)
            self.log("warning" if self._cancel else "error", str(e)[:4000], {"error_code": self.error_code})
            return None
        finally:
            self.spark.sparkContext.removeJobTag(self.run_id)

    def operator(self, registry: Registry, key: str, df: DataFrame, **given: object) -> DataFrame | None:
        """Run a registered operator."""
        return self.execute(lambda run: registry.run(key, df, **given))

    def log_rows(self) -> DataFrame:
        return self.spark.createDataFrame(self.lines, LOG)


def results(reported: DataFrame) -> DataFrame:
    """task_id, n, model_name, metrics_json, summary, artifacts_json of evaluation outputs (task_id, result_json).

    An output lists its `results`, possibly none; one without such a list is a single result itself. Names default to
    `default-evaluator`, metrics to {}, summaries to an empty text, artifacts to []. Outputs that don't parse give no rows.
    """
    j = F.col("result_json")
    ok = reported.where(F.try_parse_json(j).isNotNull() & j.rlike(r"^\s*\{"))
    listed = F.get_json_object(j, "$.results")
    items = F.when(listed.isNotNull(), F.from_json(listed, f"array<{RESULT}>")).otherwise(F.array(F.from_json(j, RESULT)))
    x = ok.select("task_id", F.posexplode(items).alias("n", "r"))
    return x.select("task_id", F.col("n").cast("bigint").alias("n"), F.coalesce("r.model_name", F.lit("default-evaluator")).alias("model_name"), F.coalesce("r.metrics", F.lit("{}")).alias("metrics_json"), F.coalesce("r.summary", F.lit("")).alias("summary"), F.coalesce("r.artifacts", F.lit("[]")).alias("artifacts_json"))


def write_reports(rows: DataFrame, path: str, key: str = "task_id") -> None:
    """A folder of JSON lines for each key, written in parallel: one report is path/key=value."""
    rows.write.mode("overwrite").partitionBy(key).json(path)


def report_rows(rows: DataFrame, key: str = "task_id") -> DataFrame:
    """key, items, report: one JSON document a key with its rows in order of n; meant for what a person reads."""
    item = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.count("*").alias("items"), F.to_json(F.array_sort(F.collect_list(item))).alias("report"))


def random_preview(samples: DataFrame, dataset_id: int, limit: int = 20, status: str | None = None, seed: int | None = None) -> tuple[int, DataFrame]:
    """(total, at most limit (0..200) rows in random order) of a dataset's samples."""
    x = samples.where(F.col("dataset_id") == dataset_id)
    x = x.where(F.col("status") == status) if status else x
    shown = max(0, min(int(limit or 0), 200))
    order = F.rand() if seed is None else F.xxhash64("id", F.lit(seed))
    return x.count(), x.orderBy(order, "id").limit(shown) if shown else x.where("false")


def disk_usage(path: str) -> dict[str, float | bool]:
    """Size, free and used space of a local disk in GB; zeros where it can't be told (shared stores have none)."""
    import shutil

    try:
        d = shutil.disk_usage(path)
    except OSError:
        return {"disk_total_gb": 0.0, "disk_free_gb": 0.0, "disk_used_gb": 0.0, "storage_available": False}
    gb = lambda n: round(n / 1024**3, 1)
    return {"disk_total_gb": gb(d.total), "disk_free_gb": gb(d.free), "disk_used_gb": gb(d.used), "storage_available": d.free > 0}


def system_stats(datasets: DataFrame, samples: DataFrame) -> DataFrame:
    """total_datasets, total_samples, processed_samples, total_size of everything, deleted or not."""
    of = samples.agg(F.count("*").alias("total_samples"), F.count_if(F.col("status").isin("processed", "cleaned", "enhanced")).alias("processed_samples")).first()
    x = datasets.agg(F.count("*").alias("total_datasets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"))
    return x.select("total_datasets", F.lit(of["total_samples"]).alias("total_samples"), F.lit(of["processed_samples"]).alias("processed_samples"), "total_size")
