"""Session helpers: table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where none is named, a session on one machine (tests) gets a temporary folder; on a cluster that is an error, as a
    machine's own folder is lost with it.
    """
    sc = spark.sparkContext
    now = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if now is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        now = f"file://{tempfile.mkdtemp(prefix='sedimento-')}"
        sc.setCheckpointDir(now)
    return now


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_runs: dict[str, str] = {}


def clean(spark: SparkSession) -> None:
    """Remove this program's written tables; what was read from them can't be read again. Happens at the program's end too,
    if the session still runs then: programs that stop it earlier call this first."""
    path = _runs.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)


def _run_folder(spark: SparkSession) -> str:
    """The folder of this program's written tables."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{checkpoint_dir(spark).rstrip('/')}/sedimento-{uuid.uuid4().hex}"

        def at_end() -> None:
            path = _runs.get(app)
            try:
                clean(spark)
            except Exception:  # noqa: BLE001 the session has ended before
                if path and path.startswith("file:"):
                    shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)

        atexit.register(at_end)
    return _runs[app]


def cut(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: what follows reads it, so plans stay short and lost executors lose nothing.

    A table also tells the optimizer its true size; plans that go on from a checkpoint multiply the sizes that were
    estimated before, which doubles the digits of that number in every round of an iteration.
    """
    path = f"{_run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut, and aggregates of the rows that were written, taken in the same job."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in counts.items()]))
    return out, seen.get


def release(*tables: DataFrame) -> None:
    """Remove tables of `cut` that no plan will read again: finished rounds of an iteration."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            _delete(t.sparkSession, path)


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or os.cpu_count() or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
