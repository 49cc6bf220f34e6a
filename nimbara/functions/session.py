"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_LOCAL: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for vectorised Python functions."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    if sc.master.startswith("local") and str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return  # Python workers already find it
    at = Path(tempfile.mkdtemp(prefix="nimbara-ship-")) / "nimbara_ship.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="nimbara-scratch-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def from_local(spark: SparkSession, pdf, schema: str):
    """A DataFrame from a small pandas frame under an explicit schema."""
    return spark.createDataFrame(pdf.to_dict("records"), schema)
