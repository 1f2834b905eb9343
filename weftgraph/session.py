"""Sessions: the library's code on every executor, and defaults for tests."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of ``spark``, once a context.

    Spark's own file server distributes the archive, so executors need no
    folder in common with the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="ship-")
    archive = os.path.join(folder, f"{root.name}_code.zip")
    Path(archive).write_bytes(body.getvalue())
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``.  Only a local
    session, which has no other executors, may do without the setting; a folder
    of its own is made and set then."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below ``shared_base``."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that a task sorts or groups at once, where tables of any size are dealt.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` to as many tasks as ``rows``, its number of rows,
    asks for, if those are more than Spark's own number: then the memory of a
    task doesn't grow with the table."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-rows // TASK_ROWS)), *columns)


def local_session(name: str = "tests", cores: str = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
