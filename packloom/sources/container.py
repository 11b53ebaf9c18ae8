"""Reader of the single-file binary container (versions 1 to 3).

Sections are described as schemas of fixed-size little-endian values, length
prefixed lists and tagged options; one generic walker reads them all.  Header,
dictionaries and index are read by the driver, as one container's index is one
list; bodies are read by tasks, each entry from its own byte ranges, so the
container has to lie where executors can open it.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..functions.delta import decode_buffer
from .config import BOMB_BYTES

# Fixed values of the format. A schema is a struct code, "bytes", "text", ["list", of], ["option", of], or {field: schema}.
MAGIC = b"NPCK"
TYPES = ["Texture", "Mesh", "Audio", "Unknown"]
PRE_ENCODINGS = ["None", "DeltaBytes"]
HEADER = {"magic": "4s", "version": "H", "metadata_length": "Q", "dictionary_length": "Q", "body_offset": "Q", "index_offset": "Q", "index_length": "Q"}
PATTERN = {"id": "I", "hash": "Q", "bytes": "bytes", "frequency": "Q", "benefit": "Q"}
CHUNK = {"chunk_hash": "Q", "body_offset": "Q", "body_length": "Q", "uncompressed_length": "Q", "compressed": "?"}
ENTRY_V1 = {"relative_path": "text", "asset_type": "I", "content_hash": "Q", "compressed_offset": "Q", "compressed_length": "Q", "uncompressed_length": "Q", "duplicate_of": ["option", "text"], "pre_encoding": "I"}
ENTRY = ENTRY_V1 | {"chunks": ["list", CHUNK], "is_stored_raw": "?"}
DICTIONARY_V1 = {"patterns": ["list", PATTERN]}
DICTIONARY = DICTIONARY_V1 | {"texture": "bytes", "mesh": "bytes", "other": "bytes"}
INDEX_DDL = "relative_path string, asset_type string, content_hash decimal(20,0), compressed_offset long, compressed_length long, uncompressed_length long, duplicate_of string, pre_encoding string, chunks array<struct<chunk_hash: decimal(20,0), body_offset: long, body_length: long, uncompressed_length: long, compressed: boolean>>, is_stored_raw boolean"


class Corrupt(ValueError):
    """Not a container, or damaged."""


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        if size < 0 or self.at + size > len(self.data):
            raise Corrupt("section ends early")
        self.at += size
        return self.data[self.at - size : self.at]

    def read(self, schema: Any) -> Any:
        match schema:
            case dict():
                return {name: self.read(kind) for name, kind in schema.items()}
            case ["list", of]:
                return [self.read(of) for _ in range(self.read("Q"))]
            case ["option", of]:
                return self.read(of) if self.read("B") else None
            case "bytes":
                return self.take(self.read("Q"))
            case "text":
                return self.read("bytes").decode("utf-8", "replace")
        return struct.unpack("<" + schema, self.take(struct.calcsize("<" + schema)))[0]


def write(schema: Any, value: Any) -> bytes:
    """The counterpart of the walker."""
    match schema:
        case dict():
            return b"".join(write(kind, value[name]) for name, kind in schema.items())
        case ["list", of]:
            return write("Q", len(value)) + b"".join(write(of, x) for x in value)
        case ["option", of]:
            return b"\0" if value is None else b"\1" + write(of, value)
        case "bytes":
            return write("Q", len(value)) + value
        case "text":
            return write("bytes", value.encode())
    return struct.pack("<" + schema, value)


HEADER_BYTES = len(write(HEADER, dict.fromkeys(HEADER, 0) | {"magic": MAGIC}))


def open_container(path: str) -> dict[str, Any]:
    """Header, dictionaries and index; entries of version 1 get no chunks and are not stored raw."""
    with open(path, "rb") as file:
        header = _Cursor(file.read(HEADER_BYTES)).read(HEADER)
        if header["magic"] != MAGIC:
            raise Corrupt("bad magic")
        if header["body_offset"] != HEADER_BYTES + header["metadata_length"] + header["dictionary_length"]:
            raise Corrupt("the body does not follow the dictionary")
        if header["index_offset"] < header["body_offset"]:
            raise Corrupt("the index lies before the body")
        if header["index_offset"] + header["index_length"] > os.path.getsize(path):
            raise Corrupt("the index ends behind the file")
        metadata = file.read(header["metadata_length"])
        section = _Cursor(file.read(header["dictionary_length"]))
        dictionary = section.read(DICTIONARY if header["version"] >= 3 else DICTIONARY_V1)
        file.seek(header["index_offset"])
        index = _Cursor(file.read(header["index_length"])).read(["list", ENTRY if header["version"] > 1 else ENTRY_V1])
    for entry in index:
        for name, names in (("asset_type", TYPES), ("pre_encoding", PRE_ENCODINGS)):
            if entry[name] >= len(names):
                raise Corrupt(f"unknown {name}")
            entry[name] = names[entry[name]]
        entry.setdefault("chunks", [])
        entry.setdefault("is_stored_raw", False)
    return {"header": header, "metadata": metadata, "dictionary": dictionary, "index": index}


def index_table(spark: SparkSession, opened: dict[str, Any]) -> DataFrame:
    """The index with the columns that ``operators.listing`` takes; hashes unsigned."""
    rows = [e | {"content_hash": Decimal(e["content_hash"]), "chunks": [c | {"chunk_hash": Decimal(c["chunk_hash"])} for c in e["chunks"]]} for e in opened["index"]]
    return spark.createDataFrame(rows, INDEX_DDL)


def patterns_table(spark: SparkSession, opened: dict[str, Any]) -> DataFrame:
    rows = [(p["id"], bytearray(p["bytes"]), p["frequency"], p["benefit"]) for p in opened["dictionary"]["patterns"]]
    return spark.createDataFrame(rows, "id int, pattern binary, frequency long, benefit long")


def _segments(payload: bytes, patterns: list[bytes]) -> bytes:
    """Version 1 bodies: literals (tag 0) and references to patterns (tag 1)."""
    cursor, out = _Cursor(payload), []
    for _ in range(cursor.read("Q")):
        tag = cursor.read("I")
        if tag == 0:
            out.append(cursor.read("bytes"))
        else:
            number = cursor.read("I")
            if tag != 1 or number >= len(patterns):
                raise Corrupt("unknown pattern")
            out.append(patterns[number])
    return b"".join(out)


def _decode(file: Any, body: int, entry: dict[str, Any], dictionary: dict[str, Any], large: int) -> bytes:
    def piece(offset: int, size: int) -> bytes:
        file.seek(body + offset)
        data = file.read(size)
        if len(data) != size:
            raise Corrupt("body ends early")
        return data

    if sum(c["uncompressed_length"] for c in entry["chunks"]) > BOMB_BYTES or entry["uncompressed_length"] > BOMB_BYTES:
        raise Corrupt("contents would be too large")
    if entry["chunks"]:
        name = entry["asset_type"].lower() if entry["asset_type"] in ("Texture", "Mesh") else "other"
        words = dictionary.get(name) or b""
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        parts = [(unpack.decompress(raw, max_output_size=c["uncompressed_length"]) if c["compressed"] else raw) for c in entry["chunks"] for raw in (piece(c["body_offset"], c["body_length"]),)]
        data = b"".join(parts)
    elif not entry["uncompressed_length"] and not entry["compressed_length"]:
        return b""
    else:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(piece(entry["compressed_offset"], entry["compressed_length"]))
        if entry["uncompressed_length"] < large:
            data = _segments(data, [p["bytes"] for p in dictionary["patterns"]])
    return decode_buffer(data) if entry["pre_encoding"] == "DeltaBytes" and (entry["chunks"] or entry["uncompressed_length"] < large) else data


def container_contents(spark: SparkSession, path: str, opened: dict[str, Any] | None = None, large: int = 256 << 20) -> DataFrame:
    """``relative_path, content, reason`` of every entry that stores bytes, checked against its hash.

    Files of at least ``large`` bytes without chunks are plain streams; smaller
    ones are lists of literals and patterns.
    """
    opened = opened or open_container(path)
    stored = [(json.dumps(e),) for e in opened["index"] if e["duplicate_of"] is None]  # a task gets its own entries only
    body, dictionary = opened["header"]["body_offset"], opened["dictionary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as file:
            for batch in batches:
                for entry in map(json.loads, batch.column(0).to_pylist()):
                    content, reason = None, None
                    try:
                        content = _decode(file, body, entry, dictionary, large)
                        if xxhash.xxh3_64_intdigest(content) != entry["content_hash"] and (content or entry["uncompressed_length"]):
                            content, reason = None, "hash mismatch"
                    except (Corrupt, zstandard.ZstdError, struct.error) as error:
                        reason = str(error) or "damaged"
                    yield pa.RecordBatch.from_arrays([pa.array([entry["relative_path"]]), pa.array([content], pa.binary()), pa.array([reason], pa.string())], ["relative_path", "content", "reason"])

    return spark.createDataFrame(stored, "entry string").mapInArrow(run, "relative_path string, content binary, reason string")
