"""Session factory and the shared staging area used to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution; ``conf`` adds or replaces settings."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("TREMOLO_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local mode, tests) a temporary folder of this machine is used.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tremolo-")
        sc.setCheckpointDir(named)
    return str(named)


#: Bytes of input to a core below which a table is dealt out again: its files are read in fewer tasks than there are cores.
SMALL_BYTES = 32 << 20


def cores(spark: SparkSession) -> int:
    """Tasks that the session runs at once, as its shuffles count on."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is a small table (by Spark's estimate) that much work is done for; large ones are read by splits, and stay as they are."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores(spark)) if size < SMALL_BYTES * cores(spark) else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by keys over as many tasks as shuffles have: for work that is heavy for its bytes, where adaptive execution would put partitions together by size alone."""
    return df.repartition(cores(df.sparkSession), *keys)


#: Deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Stages whose folders may still be read, by folder.
_open: dict[str, Stage] = {}


class Stage:
    """Written intermediate tables: they cut lineage and survive lost executors.

    Tables stay until ``close``, ``close_stages`` or the end of the program, as lazy results may read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tremolo-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not _open:
            atexit.unregister(close_stages)
            atexit.register(close_stages)  # after the gateway's own, so it runs before it
        _open[self.root] = self

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet into the shared folder and read it back.

        What was shuffled for it is deleted as soon as it is written: nothing reads that again.
        """
        self._n += 1
        path = f"{self.root}/{self._n}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``write`` returned, once nothing lazy reads it."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(path)

    def close(self) -> None:
        _open.pop(self.root, None)
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def close_stages(keep: Iterable[str] = ()) -> None:
    """Deletes the tables of all open stages but those whose folders are in ``keep``: results that read them must be written by then."""
    for root, stage in list(_open.items()):
        if root not in keep:
            _open.pop(root, None)
            try:
                if stage.spark.sparkContext._jsc is not None:
                    stage._delete(root)
            except Exception:  # the session may have ended
                pass


@contextmanager
def passing() -> Iterator[None]:
    """Closes the stages that were opened inside when it ends: what is needed of them is written by then."""
    before = set(_open)
    try:
        yield
    finally:
        close_stages(before)
