"""Models of bounded size for all workers: unpacked once per worker, with the code of their classes."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def share(spark: SparkSession, value):
    """A broadcast of ``value``; read it with ``use``."""
    return spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})


def use(shared):
    """The shared value; a worker that serves several tasks keeps one copy."""
    box = shared.value
    if "value" not in box:
        box["value"] = cloudpickle.loads(box["packed"])
    return box["value"]
