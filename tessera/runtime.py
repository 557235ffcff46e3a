"""What functions on the executors need: the package's code, and a folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch on its way to a Python worker. Spark's own 64 MB would be held by each worker of a
#: stage, and again by each step of its work.
BATCH_BYTES = 8 << 20

_shipped: set[str] = set()
_roots: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, and bound the session's batches where they have Spark's own number.

    Functions of the package are pickled by reference, so a Python worker has
    to be able to import it, also where the checkout is not at hand. The bound
    stays in the session; what a user has set is left alone.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessera-ship-")
    archive = os.path.join(folder, "tessera_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for here, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(here, n)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    sc.addPyFile(archive)  # served from here as long as the application lives
    atexit.register(shutil.rmtree, folder, True)
    _shipped.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the one given to ``setCheckpointDir``.

    Only on one machine (a local master), where neither is set, a temporary
    folder is made and set; on a cluster that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if sc.applicationId in _roots:
        return _roots[sc.applicationId]
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="tessera-scratch-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(f"file://{folder}")
    _roots[sc.applicationId] = f"file://{folder}"
    return _roots[sc.applicationId]
