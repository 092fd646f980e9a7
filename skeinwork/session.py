"""Session set-up and the few helpers that need the session itself."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "skeinwork", cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Local session for tests and benches; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in spark.checkpoint.dir, else (tests only) a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="skeinwork-")
    return _LOCAL[key]


_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written once to a table in the shared folder and read from there: a short plan that survives lost executors.

    (A checkpoint would compute df a second time to write it.) The tables are removed when the driver ends.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_folder(spark)}/skeinwork-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


@atexit.register
def remove_written() -> None:
    """Delete what was written to shared paths; it must not be needed any more."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            sc = spark.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has already ended
            pass
    for folder in _LOCAL.values():
        shutil.rmtree(folder, ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
