"""Level 5 MAT files: real numeric matrices by name, and recordings as signals. The public format, read without other libraries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Element types of the format (fixed values): numpy's name by number; matrices and compressed elements.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
#: Array classes that hold numbers (fixed values).
NUMERIC = range(6, 16)
COLUMNS = "sample_id string, idx long, ts double, amplitude double, sampling_rate double, rotation_speed long, error string"


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, content) of the elements that follow one another; each is padded to 8 bytes, small ones hold 4 bytes in their tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        if at + 8 + size > len(data):
            raise ValueError("the file ends within an element")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def matrices(data: bytes) -> dict[str, np.ndarray]:
    """The real numeric matrices of a file by name; other kinds of variables are passed over. ValueError if it is no such file."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order = "<" if data[126:128] == b"IM" else ">"
    out = {}
    for kind, content in _elements(data[128:], order):
        if kind == COMPRESSED:
            try:
                kind, content = next(_elements(zlib.decompress(content), order))
            except (zlib.error, StopIteration) as e:
                raise ValueError("a compressed element is broken") from e
        if kind != MATRIX or not content:
            continue
        flags, shape, name, *parts = _elements(content, order)
        if struct.unpack_from(order + "I", flags[1])[0] & 0xFF not in NUMERIC or not parts:
            continue
        if parts[0][0] not in KINDS:
            raise ValueError(f"unknown element type {parts[0][0]}")
        size = np.frombuffer(shape[1], order + "i4")
        out[name[1].decode("ascii", "replace")] = np.frombuffer(parts[0][1], order + KINDS[parts[0][0]]).reshape(size, order="F")
    return out


def recording(data: bytes, number: int | None = None) -> tuple[np.ndarray, int | None]:
    """The drive end's signal and, if the file has it, the speed.

    The signal is X<number>_DE_time, else the first variable whose name ends so; the speed is
    X<number>RPM, X<number>_RPM or RPM. ValueError if there is none, or if it is empty.
    """
    found = matrices(data)
    own = [f"X{number:03d}_DE_time"] if number is not None else []
    named = [k for k in own if k in found] or [k for k in found if k.endswith("_DE_time")]
    if not named or not found[named[0]].size:
        raise ValueError("no signal of the drive end")
    speeds = ([f"X{number:03d}RPM", f"X{number:03d}_RPM"] if number is not None else []) + ["RPM"]
    speed = next((int(found[k].ravel()[0]) for k in speeds if k in found and found[k].size), None)
    return found[named[0]].ravel(order="F").astype(float), speed


def read_mat(spark: SparkSession, path: str, sampling_rate: float) -> DataFrame:
    """COLUMNS of recordings: a row for each point; of a file that can't be read one row with the error.

    Files are named by their number, such as 105.mat. A file is read whole in one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    x, speed = recording(bytes(content), int(name) if name.isdigit() else None)
                except ValueError as e:
                    yield pd.DataFrame({"sample_id": [name], "idx": [None], "ts": [None], "amplitude": [None], "sampling_rate": [sampling_rate], "rotation_speed": [None], "error": [str(e)]}).astype({"idx": "Int64", "rotation_speed": "Int64"})
                    continue
                idx = np.arange(len(x))
                yield pd.DataFrame({"sample_id": name, "idx": idx, "ts": idx / sampling_rate, "amplitude": x, "sampling_rate": sampling_rate, "rotation_speed": pd.array([speed] * len(x), "Int64"), "error": None})

    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return spark.read.format("binaryFile").load(path).select(name.alias("name"), "content").mapInPandas(run, COLUMNS)


class SignalMat(DataSource):
    """``spark.read.format("signal-mat")``: COLUMNS of MAT files, one partition a file and variable; ``register`` makes the name known.

    Options: path (a file, or a folder whose .mat files are read; any file system that Arrow knows), samplingRate, and
    variables, a list by commas: then each file gives a sample for each of them, named file:variable, else the drive end's signal.
    """

    @classmethod
    def name(cls) -> str:
        return "signal-mat"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MatReader(self.options)


class _Part(InputPartition):
    def __init__(self, file: str, variable: str):
        super().__init__((file, variable))
        self.file, self.variable = file, variable


class _MatReader(DataSourceReader):
    #: Points to a batch.
    POINTS = 1 << 16

    def __init__(self, options: dict):
        if not options.get("path") or not options.get("samplingrate", options.get("samplingRate")):
            raise ValueError("signal-mat needs a path and a samplingRate")
        self.path, self.rate = options["path"], float(options.get("samplingrate", options.get("samplingRate")))
        self.variables = [v.strip() for v in options.get("variables", "").split(",") if v.strip()]

    def _store(self):
        return pa.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pa.fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        store, root = self._store()
        info = store.get_file_info(root)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(pa.fs.FileSelector(root))
        names = sorted(f.path for f in found if f.is_file and f.path.endswith(".mat"))
        return [_Part(f, v) for f in names for v in self.variables or [""]]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        with self._store()[0].open_input_stream(part.file) as f:
            data = f.read()
        name = part.file.rsplit("/", 1)[-1].removesuffix(".mat")
        sample = f"{name}:{part.variable}" if part.variable else name
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in COLUMNS.split(", ")])
        try:
            x, speed = recording(data, int(name) if name.isdigit() else None) if not part.variable else (matrices(data)[part.variable].ravel(order="F").astype(float), None)
        except (ValueError, KeyError) as e:
            message = f"no variable {part.variable}" if isinstance(e, KeyError) else str(e)
            yield pa.RecordBatch.from_pylist([{"sample_id": sample, "sampling_rate": self.rate, "error": message}], schema)
            return
        for at in range(0, len(x), self.POINTS):
            idx = np.arange(at, min(at + self.POINTS, len(x)))
            fixed = lambda v, kind: pa.array([v] * len(idx), kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([fixed(sample, pa.string()), pa.array(idx), pa.array(idx / self.rate), pa.array(x[idx]), fixed(self.rate, pa.float64()), fixed(speed, pa.int64()), fixed(None, pa.string())], schema=schema)


def register(spark: SparkSession) -> None:
    """Makes the format "signal-mat" known to a session."""
    spark.dataSource.register(SignalMat)
