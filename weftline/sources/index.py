"""Symbol indexes in protobuf form as a Spark data source: one row a document, read in pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers, and bytes of length-delimited ones."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            value, at = varint(data, at)
        elif key & 7 == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def packed(data: int | bytes) -> list[int]:
    if isinstance(data, int):
        return [data]
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def document(data: bytes) -> tuple[str, str, str]:
    """(relative path, language, occurrences as JSON [range, symbol, roles, enclosing range])."""
    path = lang = ""
    found = []
    for number, value in fields(data):
        if number == 1:
            path = value.decode()
        elif number == 4:
            lang = value.decode()
        elif number == 2:
            o = {"range": [], "symbol": "", "roles": 0, "enclosing": []}
            for k, v in fields(value):
                if k == 1:
                    o["range"] += packed(v)
                elif k == 2:
                    o["symbol"] = v.decode()
                elif k == 3:
                    o["roles"] = v
                elif k == 7:
                    o["enclosing"] += packed(v)
            found.append(o)
    return path, lang, json.dumps(found)


def documents(stream, piece: int = 1 << 16) -> Iterator[bytes]:
    """The documents (field 2) of an index, without holding the rest of it."""
    buffer, ended = bytearray(), False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(buffer) < n and not ended:
            got = stream.read(piece)
            ended = not got
            buffer.extend(got)
        return len(buffer) >= n

    while True:
        fill(20)
        if not buffer:
            return
        key, at = varint(buffer, 0)
        n, at = varint(buffer, at)
        if key & 7 == 0:
            del buffer[:at]
            continue
        if not fill(at + n):
            raise ValueError("the index ends inside a field")
        if key >> 3 == 2:
            yield bytes(buffer[at : at + n])
        del buffer[: at + n]


class SymbolIndex(DataSource):
    """spark.read.format("symbol_index").load(path); path may name several files, joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "symbol_index"

    def schema(self) -> str:
        return "path string, language string, occurrences string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.paths = path.split(",")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(partition.value) if "://" in partition.value else (fs.LocalFileSystem(), partition.value)
        with store.open_input_stream(name, compression=None) as f:
            for data in documents(f):
                yield document(data)
