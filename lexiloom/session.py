"""Session helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "lexiloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (UTC, ANSI, adaptive execution); ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that are written and read again: under ``spark.checkpoint.dir``, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratched.append((spark, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read back: cuts a long lineage, and survives lost executors."""
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


def drop_kept(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` returned, once nothing that is still to be computed reads them (an iteration's earlier states)."""
    paths = {getattr(t, "_lexiloom_path", None) for t in tables}
    _delete([x for x in _scratched if x[1] in paths])
    _scratched[:] = [x for x in _scratched if x[1] not in paths]


_scratched: list = []


def _forget() -> None:
    _delete(_scratched)


def _delete(found: list) -> None:
    for spark, path in found:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone
            pass


atexit.register(_forget)


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="lexiloom-py-"), "lexiloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
