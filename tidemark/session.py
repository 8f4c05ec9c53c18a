"""Session settings and the shared folder that all executors can reach."""

from __future__ import annotations

import atexit
import contextlib
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Settings of sessions that the library opens itself; given sessions are left as they are.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g", **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    plain = path.removeprefix("file://")
    if plain.startswith("/"):
        shutil.rmtree(plain, ignore_errors=True)
    else:
        with contextlib.suppress(Exception):  # the session may be gone; its folder then outlives it
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    """At the end of the driver, remove what it wrote to the shared folder."""
    for spark, path in _made:
        _delete(spark, path)


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside is removed at the end; for queries whose result is consumed inside."""
    kept = list(_made)
    try:
        yield
    finally:
        for made in [m for m in _made if m not in kept]:
            _delete(*made)
            _made.remove(made)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is absent and all runs on one machine, as in tests, a temporary folder is used; on a cluster
    its absence is an error, for a folder of each machine's own would lose results. The session's settings stay as they are.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = _local.get(context.applicationId)
        if base is None:
            base = _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            _made.append((spark, base))
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in the Python workers of a session, whatever their path is; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return spark
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"tidemark/{f.relative_to(root)}")
    sc.addPyFile(str(target))  # the driver serves it to every executor, also to those that join later
    sc._tidemark_shipped = True
    return spark
