"""Record files: rows of any schema as framed, check-summed records, read and written by a data source of Spark's.

A file is a mark, then records: eight bytes of length, a checksum of these, the row as JSON, a checksum of that.  A folder is
what its manifest lists.  Writing tasks fill files of bounded size in a folder of their own; the driver lists them in the
manifest, in one step, when all tasks are done, so a failed write leaves no row, and an overwrite keeps the old rows until
then.  What tasks still wrote while their job was given up is in no manifest; ``vacuum`` deletes it.  Every file is read by a task of its own.

Tasks open the files themselves, so the path must be a folder that all machines mount.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, Row, StructType

MARK, NAME, MANIFEST = b"LWRECORD1\n", "linkwell_records", "_manifest.json"
#: Bytes from which on a task begins its next file, unless the option ``file_bytes`` says otherwise.
FILE_BYTES = 64 << 20
_HEAD, _SUM = struct.Struct("<QI"), struct.Struct("<I")


class DamagedRecord(ValueError):
    pass


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + _SUM.pack(zlib.crc32(size)) + payload + _SUM.pack(zlib.crc32(payload))


def payloads(path: str) -> Iterator[bytes]:
    """The records of a file; DamagedRecord if a checksum or a length does not hold."""
    with open(path, "rb") as f:
        if f.read(len(MARK)) != MARK:
            raise DamagedRecord(f"{path} is no record file")
        number = 0
        while head := f.read(_HEAD.size):
            number += 1
            if len(head) < _HEAD.size or zlib.crc32(head[:8]) != _HEAD.unpack(head)[1]:
                raise DamagedRecord(f"{path}: length of record {number}")
            size = _HEAD.unpack(head)[0]
            body = f.read(size)
            end = f.read(_SUM.size)
            if len(body) < size or len(end) < _SUM.size or zlib.crc32(body) != _SUM.unpack(end)[0]:
                raise DamagedRecord(f"{path}: record {number}")
            yield body


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: record files need a folder that all machines mount")
    return path.removeprefix("file://")


def _manifest(path: str) -> dict | None:
    where = f"{path}/{MANIFEST}"
    if not os.path.exists(where):
        return None
    with open(where, encoding="utf-8") as f:
        return json.load(f)


def _plain(value):
    if isinstance(value, Row):
        return [_plain(v) for v in value]
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def _shaped(value, kind: DataType):
    """What was read as JSON, with tuples for structs."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(_shaped(v, f.dataType) for v, f in zip(value, kind.fields, strict=True))
    if isinstance(kind, ArrayType):
        return [_shaped(v, kind.elementType) for v in value]
    return value


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(f"{self.path}/{f}") for f in (_manifest(self.path) or {"files": []})["files"]]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        for body in payloads(partition.path) if partition else ():  # without files Spark asks for no partition in particular
            yield _shaped(json.loads(body), self.schema)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, file_bytes: int):
        self.path, self.schema, self.overwrite, self.file_bytes = path, schema, overwrite, file_bytes
        self.folder = f"data-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Written:
        os.makedirs(f"{self.path}/{self.folder}", exist_ok=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for row in iterator:
                if out is None or size >= self.file_bytes:
                    if out:
                        out.close()
                    files.append(f"{self.folder}/{uuid.uuid4().hex}.rec")
                    out, size = open(f"{self.path}/{files[-1]}", "wb"), len(MARK)  # noqa: SIM115
                    out.write(MARK)
                body = frame(json.dumps([_plain(v) for v in row], ensure_ascii=False).encode())
                out.write(body)
                size += len(body)
        except BaseException:
            for f in files:
                os.remove(f"{self.path}/{f}")
            raise
        finally:
            if out:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        files, before = sorted(f for m in messages if m for f in m.files), _manifest(self.path)
        if before and not self.overwrite:
            if before["schema"] != json.loads(self.schema.json()):
                raise ValueError(f"{self.path} holds another schema")
            files = before["files"] + files
        os.makedirs(self.path, exist_ok=True)
        draft = f"{self.path}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump({"schema": json.loads(self.schema.json()), "files": files}, f)
        os.replace(draft, f"{self.path}/{MANIFEST}")
        for folder in {f.split("/")[0] for f in (before or {"files": []})["files"]} - {f.split("/")[0] for f in files}:
            shutil.rmtree(f"{self.path}/{folder}", ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(f"{self.path}/{self.folder}", ignore_errors=True)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        held = _manifest(_local(self.options["path"]))
        if held is None:
            raise FileNotFoundError(f"no record files at {self.options['path']}")
        return StructType.fromJson(held["schema"])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(_local(self.options["path"]), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(_local(self.options["path"]), schema, overwrite, int(self.options.get("file_bytes", FILE_BYTES)))


def write(df: DataFrame, path: str, mode: str = "overwrite", file_bytes: int = FILE_BYTES) -> None:
    """Write rows of numbers, strings, booleans, arrays and structs of them; ``append`` adds to a folder of the same schema."""
    df.sparkSession.dataSource.register(RecordSource)
    df.write.format(NAME).option("file_bytes", str(file_bytes)).mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.read.format(NAME).load(path)


def vacuum(path: str, least_age: float = 86_400) -> int:
    """Delete the folders of data that the manifest does not list and that are ``least_age`` seconds old; their number.

    The age protects what another writer has written but not committed.
    """
    where = _local(path)
    listed = {f.split("/")[0] for f in (_manifest(where) or {"files": []})["files"]}
    old = [d for d in os.listdir(where) if d.startswith("data-") and d not in listed and os.path.getmtime(f"{where}/{d}") <= time.time() - least_age]
    for d in old:
        shutil.rmtree(f"{where}/{d}", ignore_errors=True)
    return len(old)
