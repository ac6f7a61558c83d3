"""A query engine for records whose fields are bags of values, and for the files of a music library, on PySpark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once; where it is installed on all machines there is no need.

    The archive stands in the driver's own folder, from where Spark hands it to the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # imported from such an archive
        return
    folder = tempfile.mkdtemp(prefix="tessitura-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "tessitura"), "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(sc.applicationId)
