"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# What a job-analytics session should run with; the cluster's own values win.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even when a later step then needs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Wide projections make generated methods the JVM would otherwise only interpret.
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def local_session(cores: str = "8", app: str = "jobfacts", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="jobfacts-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def shipped(spark: SparkSession) -> None:
    """Hand this package to the Python workers, as `spark-submit --py-files` does; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "jobfacts_package", False):
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="jobfacts-package-")) / "jobfacts-package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context.jobfacts_package = True
