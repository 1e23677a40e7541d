"""Tables in the folder that every executor shares.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without that setting, such as a
test, gets a temporary one. What is written there is deleted by the job that needed it, or else when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folders that are still there, with what it takes to delete them.
_open: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session. A cluster without one is an error, as its executors share no other folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return str(named).rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sluicework-"))
    return str(sc.getCheckpointDir()).rstrip("/")


def _delete(jvm, conf, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def _sweep() -> None:
    for root, (jvm, conf) in _open.items():
        try:
            _delete(jvm, conf, root)
        except (Py4JError, OSError):  # the JVM is gone
            return


class Scratch:
    """Parquet tables of one job, in a folder of its own under the shared folder."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        _open[self.root] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and read it back."""
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing will read again; without a name, all of them."""
        jvm, conf = _open[self.root]
        _delete(jvm, conf, self.path(name) if name else self.root)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a written table, so that a lost executor costs no recomputation. The table
    stays until the driver ends."""
    return Scratch(df.sparkSession, "cut").table(df, "rows")
