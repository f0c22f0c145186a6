"""A table kept in versions: rows by buckets of their key, and a pointer that a rename replaces.

A version writes only the buckets whose rows change, in a folder of its own; the pointer lists the folder
that holds each bucket. Readers see the pointer's version as a whole: one that is being written, or whose
writing failed, is no part of it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The pointer's name, the column that names buckets on disk, and how many there are unless stated.
POINTER, BUCKET, BUCKETS = "_CURRENT", "_bucket", 64


@dataclass(frozen=True)
class Version:
    """What a pointer says: its number, the key, the buckets, by bucket the folder that holds it, the folders of the version before, the rows' schema, and notes of the writer."""

    number: int
    key: str
    buckets: int
    folders: dict[int, str]
    before: tuple[str, ...]
    schema: str
    notes: dict


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _fs(spark, path)
    return fs.exists(target)


def current(spark: SparkSession, path: str) -> Version:
    """The version in force; FileNotFoundError if there is none."""
    target, fs = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(target):
        raise FileNotFoundError(path)
    stream = fs.open(target)
    try:
        said = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    return Version(said["number"], said["key"], said["buckets"], {int(k): v for k, v in said["folders"].items()}, tuple(said["before"]), json.dumps(said["schema"]), said["notes"])


def _switch(spark: SparkSession, path: str, version: Version) -> None:
    """Puts the pointer of ``version`` in the place of the one in force, in a single rename."""
    jvm = spark._jvm
    said = dict(number=version.number, key=version.key, buckets=version.buckets, folders=version.folders, before=version.before, schema=json.loads(version.schema), notes=version.notes)
    beside, fs = _fs(spark, f"{path}/{POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(json.dumps(said).encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(beside, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), options)


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """The rows of the version in force, or of some of its buckets."""
    now = current(spark, path)
    schema = StructType.fromJson(json.loads(now.schema))
    parts = [f"{path}/{folder}/{BUCKET}={k}" for k, folder in sorted(now.folders.items()) if only is None or k in only]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def write(rows: DataFrame, key: str, path: str, changed: set[int] | None = None, buckets: int = BUCKETS, notes: dict | None = None) -> Version:
    """A new version that holds ``rows`` in its ``changed`` buckets (all, if none are given) and keeps the other buckets of the version in force.

    Rows of other buckets than the changed ones aren't written; a bucket without rows goes. The pointer is
    replaced once everything is written, unless someone else replaced it meanwhile (RuntimeError: write again).
    Then folders go that neither this version nor the one before names: readers of the one before may go on.
    """
    spark = rows.sparkSession
    try:
        old = current(spark, path)
    except FileNotFoundError:
        old = None
    if old and (old.buckets != buckets or old.key != key):
        changed = None
    folder = f"v{old.number + 1 if old else 1}-{uuid.uuid4().hex[:8]}"
    made = rows.withColumn(BUCKET, bucket(F.col(key), buckets))
    if changed is not None:
        made = made.where(F.col(BUCKET).isin(sorted(changed)) if changed else F.lit(False))
    made.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    target, fs = _fs(spark, f"{path}/{folder}")
    written = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(target) if s.getPath().getName().startswith(f"{BUCKET}=")}
    kept = {} if old is None or changed is None else {k: f for k, f in old.folders.items() if k not in changed}
    before = tuple(sorted(set(old.folders.values()))) if old else ()
    version = Version(old.number + 1 if old else 1, key, buckets, kept | {k: folder for k in written}, before, rows.schema.json(), notes or {})
    try:
        now = current(spark, path).number
    except FileNotFoundError:
        now = 0
    if now != version.number - 1:
        raise RuntimeError(f"{path}: version {now} was written meanwhile")
    _switch(spark, path, version)
    _sweep(spark, path, set(version.folders.values()) | set(before), set(old.before) if old else set())
    return version


def _sweep(spark: SparkSession, path: str, keep: set[str], known: set[str]) -> None:
    """Deletes folders that the last version but one named and nothing newer does. What a failed writer left is no one's: ``clean`` deletes it."""
    for folder in known - keep:
        target, fs = _fs(spark, f"{path}/{folder}")
        fs.delete(target, True)


def clean(spark: SparkSession, path: str) -> list[str]:
    """Deletes whatever the version in force and the one before don't name, such as what failed writers left; to be called while no one writes."""
    now = current(spark, path)
    keep = set(now.folders.values()) | set(now.before) | {POINTER}
    target, fs = _fs(spark, path)
    gone = [s.getPath() for s in fs.listStatus(target) if s.getPath().getName().lstrip(".").removesuffix(".crc") not in keep]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)
