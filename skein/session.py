"""Spark session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not find it by themselves: add it as a zip, once."""
    import os
    import tempfile
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")] or getattr(context, "_skein_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="skein-"), "skein.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "skein")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._skein_shipped = True
