"""Code-health analytics and corpus operators on Spark."""

import os
from pathlib import Path

from pyspark import SparkContext


def _tell_workers() -> None:
    """Let Python workers find the package where the driver has it, if it is not installed for them otherwise."""
    root = str(Path(__file__).resolve().parents[1])
    context = SparkContext._active_spark_context
    for environment in (os.environ, *([context.environment] if context else [])):
        known = environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


_tell_workers()
