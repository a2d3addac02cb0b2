"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_own_folder: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the library's semantics rest on, to the given session itself.

    Column names are compared case-sensitively, timestamps are rendered in UTC,
    and the split layout of file scans is pinned: record positions are computed
    from one scan and joined to a second one, so both must cut files alike even
    if executors join or leave in between.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.caseSensitive", "true")
    conf.set("spark.sql.adaptive.enabled", "true")
    # Java never compiles methods above 8000 bytes; run such stages operator by
    # operator, in methods it does compile.
    conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Rows go to Python in batches of few bytes, so that what a worker holds does not grow
    # with the length of texts.
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    # Read and write CSV in any charset Java knows, Shift_JIS among them.
    conf.set("spark.sql.legacy.javaCharsets", "true")
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    _ship_package(spark)
    return spark


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="rowloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def session(app_name: str = "rowloom", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only on a local master may
    that be unset: then a temporary folder is made (and dropped at exit). Elsewhere
    every executor would write to a disk of its own, so it is an error.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share.")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="rowloom-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
