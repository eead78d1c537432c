"""Session helpers: defaults for local runs, steps written to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own session and settings."""
    shared = tempfile.mkdtemp(prefix="spark-steps-", dir="/tmp")
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("transitloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )


def step_folder(spark: SparkSession) -> str:
    """Folder for written steps: the one that ``spark.checkpoint.dir`` names.

    Only a local session, where driver and executors are one process, may do without: it gets a folder of its own, removed at
    the end. A cluster without the setting is refused, as executors would not see each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-steps-", dir="/tmp")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


#: A file of a step is read by one task; repeated names shrink to so little that size alone would leave millions of rows to it.
FILE_ROWS = 100_000


def store(df: DataFrame) -> str:
    """Writes ``df`` as a table in the step folder and returns its path."""
    path = f"{step_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return path


def store_counted(df: DataFrame, count: Column | None = None) -> tuple[str, int]:
    """Like ``store``; also returns the number of rows (or of rows where ``count`` holds), observed while writing."""
    seen = Observation()
    metric = F.count(F.lit(1)) if count is None else F.count_if(count)
    return store(df.observe(seen, metric.alias("n"))), int(seen.get["n"])


def load(spark: SparkSession, schema, *paths: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths)


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage: ``df`` is written once and read back.

    The written table survives lost executors, and its known size lets the optimizer choose the
    join strategy of the next step.
    """
    return load(df.sparkSession, df.schema, store(df))


def input_state(spark: SparkSession, folder: str) -> int:
    """A number that changes when a file below ``folder`` comes, goes, or changes in size or time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    row = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return int(row["h"] or 0)


class StepStore:
    """Remembers written steps per (application, input folder and its state, step) for reuse between queries."""

    def __init__(self) -> None:
        self._steps: dict[tuple, tuple] = {}

    def get(self, spark: SparkSession, scope: tuple, step: str, build) -> DataFrame:
        key = (spark.sparkContext.applicationId, scope, step)
        if key not in self._steps:
            df = build()
            self._steps[key] = (df.schema, store(df))
        schema, path = self._steps[key]
        return load(spark, schema, path)

    def release_others(self, spark: SparkSession) -> None:
        """Removes all written steps of the session but those kept here; for callers that are done with every other result."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(step_folder(spark))
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        kept = {path.rsplit("/", 1)[1] for _, path in self._steps.values()}
        for step in files.listStatus(folder) if files.exists(folder) else []:
            if step.getPath().getName() not in kept:
                files.delete(step.getPath(), True)


STEPS = StepStore()
