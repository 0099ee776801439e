"""Session helpers: where shared files go, and how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor can read.

    Only where the setting is absent and all runs on one machine (tests, a
    laptop) a temporary folder is made and set as the checkpoint folder of the
    context; on a cluster without the setting this fails.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            context.setCheckpointDir(named)
        return named
    if not current.isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="marginalia-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder, for files that are written and read by name."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = folder if re.match(r"[a-z0-9]+:", folder) else f"file://{folder}"
    _MADE.append(folder)
    return folder


#: Scratch folders that this process made and that still stand.
_MADE: list[str] = []


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Remove the scratch folders made since there were so many; what is lazily read from them must be written first."""
    for folder in _MADE[since:]:
        remove(spark, folder)


def made() -> int:
    return len(_MADE)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _MADE:
        _MADE.remove(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    Unlike a local checkpoint it survives the loss of an executor. The files go
    when the driver drops the result, where cleaning of checkpoints is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list:
    """What the jobs return, which run at once: small ones cost their planning more than their tasks. All end before an error is raised."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [r.result() for r in running]


def ship(spark: SparkSession) -> None:
    """Make this package importable for Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_marginalia_shipped", False):
        return
    here = Path(__file__).parent
    name = Path(tempfile.mkdtemp(prefix="marginalia-")) / "marginalia_package.zip"
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    context.addPyFile(str(name))
    context._marginalia_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
