"""Where operators keep what they compute once: tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

REST = 5.0
_collected = [0.0]
_own: dict[str, str] = {}
_open: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder if all runs in one process; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = _own.setdefault("", tempfile.mkdtemp(prefix="cellwright-"))
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables of one run, as Parquet in the shared folder.

    Writing a table cuts its lineage, and unlike a local checkpoint it outlives any executor. ``drop``
    removes tables at once. Those that a returned plan still reads go when the process ends, or with
    ``clear`` once a long session needs no earlier result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        _open.append(self)

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/t{self._n}"

    def keep(self, df: DataFrame, path: str | None = None) -> DataFrame:
        path = path or self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables, and lets Spark remove the shuffle files of finished steps: it does so when the
        driver's JVM collects the plans that made them, and not before. Asked for once in ``REST`` seconds at most.
        """
        for df in tables:
            if path := getattr(df, "_kept_at", None):
                self.remove(path)
        if time.monotonic() - _collected[0] > REST:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            _collected[0] = time.monotonic()

    def remove(self, path: str | None = None) -> None:
        try:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.root)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing left to ask
            pass


@atexit.register
def clear() -> None:
    """Remove all tables kept so far; results that still read them can't be read again."""
    while _open:
        _open.pop().remove()
