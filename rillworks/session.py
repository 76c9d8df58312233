"""The Spark session the library runs in."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Semantics the verbs rely on; everything else is the cluster's business.
SEMANTICS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark 4.1 mistakes a columnar union of inputs bucketed alike for one partitioned by key
    "spark.sql.unionOutputPartitioning": "false",
}


def session(app: str = "rillworks", master: str | None = None, **conf: object) -> SparkSession:
    """Get or create a session; `conf` keys may use "__" for ".", values win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTICS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def let_workers_import(spark: SparkSession) -> None:
    """Put this package's folder on the path of Python workers, for runs from a checkout on one machine.

    On a cluster the package is installed or shipped (`--py-files`), and the extra entry does no harm.
    """
    home, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
