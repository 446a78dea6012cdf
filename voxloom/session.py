"""Sessions: settings that suit the operators, and the package on every worker."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application, send the package's modules to the workers, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    folder = Path(tempfile.mkdtemp(prefix="voxloom-package-"))  # on the driver, which serves it
    with zipfile.ZipFile(archive := folder / "voxloom_package.zip", "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def local_session(cores: int = 8, memory: str = "20g") -> SparkSession:
    """A session on this machine, as the tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("voxloom")
        .config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cores)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
