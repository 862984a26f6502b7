"""What a session needs beyond Spark: this package on the executors, and a shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each context, unless it came from a zip that
    ``spark-submit --py-files`` has sent already."""
    sc = spark.sparkContext
    top = Path(__file__).resolve().parent
    if getattr(sc, "_gridspan_shipped", False) or not top.is_dir():
        return
    out = Path(tempfile.mkdtemp(prefix="gridspan-")) / "gridspan_code.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    sc.addPyFile(str(out))
    sc._gridspan_shipped = True


def use_checkpoints(spark: SparkSession) -> None:
    """Iterative operators cut lineage in the cluster's shared folder. Where none is set, a local session
    has a temporary one; on a cluster that is an error, since executors would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="gridspan-checkpoints-"))
