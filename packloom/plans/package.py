"""A package: Parquet tables ``index``, ``refs``, ``chunks``, ``dicts``, ``manifest`` in one folder.

Chunks are written once, compressed, with the dictionary version they were
compressed with.  A folder is written under a temporary name beside its target;
the package that is there moves aside, the new one takes its name, and the old
one is deleted.  A failure leaves the old package in place and no other folder.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.classify import codec_level, dict_class, pre_encoding, stored_raw
from ..functions.delta import BufferDecoder, decode_bytes, encode_bytes
from ..functions.hashing import xxh3_64
from ..functions.paths import basename, is_safe_relative
from ..operators import codec, duplicates
from ..operators.chunks import manifest, references
from ..operators.integrity import Ed25519, table_digest
from ..operators.versions import incremental_plan
from ..operators.windows import content_chunks
from ..sources.config import BOMB_BYTES, CDC_AVG, CDC_MAX, CDC_MIN, Settings

TABLES = ["index", "refs", "chunks", "dicts", "manifest"]
VERSION = 3
#: Bytes of dictionaries that a task holds at once; chunks of more dictionaries are read in turns.
HELD_DICTS = 32 << 20
#: A table of at most so many paths is broadcast; it is counted first.
BROADCAST_PATHS = 500_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    fs, target = _fs(spark, path)
    return fs.getContentSummary(target).getLength()


def _publish(spark: SparkSession, temp: str, path: str) -> None:
    fs, source = _fs(spark, temp)
    target, aside = _fs(spark, path)[1], _fs(spark, f"{temp}.old")[1]
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(source, target):
        if there:
            fs.rename(aside, target)
        raise OSError(f"cannot rename {temp} to {path}")
    if there:
        fs.delete(aside, True)


@contextmanager
def published(spark: SparkSession, path: str) -> Iterator[str]:
    """A temporary folder beside ``path``, published there at the end and deleted after a failure."""
    temp = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        yield temp
        _publish(spark, temp, path)
    finally:
        delete(spark, temp)


def _write_manifest(spark: SparkSession, temp: str) -> None:
    """What the written tables hold, whether built now or taken over."""
    index, refs, chunks = (spark.read.parquet(f"{temp}/{t}") for t in ("index", "refs", "chunks"))
    sums = index.agg(F.count("*").alias("asset_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_uncompressed_bytes"))
    stored = chunks.agg(F.count("*").alias("unique_chunk_count"), F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0)).alias("total_compressed_bytes"))
    hits = manifest(refs).select("dedup_hits", "dedup_bytes_saved")
    sums.crossJoin(stored).crossJoin(hits).withColumn("created_by", F.lit("packloom")).withColumn("version", F.lit(VERSION)).coalesce(1).write.parquet(f"{temp}/manifest")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _few(paths: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small, so that a join with it moves no contents."""
    return F.broadcast(paths) if paths.count() <= BROADCAST_PATHS else paths


def _chunked(assets: DataFrame, cdc: tuple[int, int, int], mesh_delta: bool) -> DataFrame:
    """Chunks of contents as they are stored: meshes as differences."""
    pre = pre_encoding(F.col("asset_type"), mesh_delta)
    kept = assets.select("relative_path", "asset_type", "content", pre.alias("pre_encoding"))
    # A UDF runs for every row of its input, so rows that need none are kept out of it.
    plain = kept.where("pre_encoding = 'None'")
    coded = kept.where("pre_encoding <> 'None'").withColumn("content", encode_bytes("content"))
    chunks = content_chunks(plain.unionByName(coded), ["relative_path", "asset_type"], *cdc)
    return chunks.withColumn("chunk_hash", xxh3_64("window"))


def build(assets: DataFrame, path: str, settings: Settings | None = None, cdc: tuple[int, int, int] = (CDC_MIN, CDC_AVG, CDC_MAX)) -> None:
    """Write a package of ``assets(relative_path, asset_type, size, hash_hex, content)``."""
    with published(assets.sparkSession, path) as temp:
        _build(assets, temp, settings or Settings(), cdc)


def _build(assets: DataFrame, temp: str, s: Settings, cdc: tuple[int, int, int]) -> None:
    spark = assets.sparkSession
    light = _written(assets.select("relative_path", "asset_type", "size", "hash_hex"), f"{temp}/light")
    dups = _written(duplicates.duplicate_map(light), f"{temp}/dups")
    copies = _few(dups.select("relative_path"))
    stored = assets.join(copies, "relative_path", "left_anti")
    # files for dictionaries are chosen by name, which moves no contents
    chosen = codec.dict_samples(light.join(copies, "relative_path", "left_anti").withColumn("content", F.lit(b""))).select("relative_path").distinct()
    dicts = codec.train_dicts(codec.dict_samples(stored.join(F.broadcast(chosen), "relative_path", "left_semi")))  # at most 100 a class
    dict_id = uuid.uuid4().hex if dicts else ""
    spark.createDataFrame([(dict_id, k, bytearray(v)) for k, v in dicts.items()], "dict_id string, dict_class string, bytes binary").write.parquet(f"{temp}/dicts")

    _chunked(stored, cdc, s.mesh_delta).write.parquet(f"{temp}/raw")
    raw = spark.read.parquet(f"{temp}/raw")
    raw_flag = stored_raw(F.col("asset_type"), F.col("relative_path"))
    references(raw.drop("window")).write.parquet(f"{temp}/marked")
    marked = spark.read.parquet(f"{temp}/marked")
    marked.select("relative_path", "ordinal", "chunk_hash", "start", "length").write.parquet(f"{temp}/refs")
    hits = marked.where(~F.coalesce("stored", F.lit(False))).select("relative_path", "ordinal", "chunk_hash")
    body = raw.where("relative_path is not null").join(_few(hits), ["relative_path", "ordinal", "chunk_hash"], "left_anti").select("chunk_hash", "length", "window", raw_flag.alias("is_raw"), dict_class(F.col("asset_type")).alias("dict_class"), codec_level(F.col("asset_type"), s.levels, s.default_level).alias("level"))
    as_is = body.where("is_raw").select("chunk_hash", "length", F.col("window").alias("data"), F.lit(False).alias("compressed"), F.lit("").alias("dict_id"), F.lit("").alias("dict_class"))
    packed = body.where("not is_raw").select("chunk_hash", "length", codec.compress("window", "level", "dict_class", dicts).alias("data"), F.lit(True).alias("compressed"), F.when(F.col("dict_class").isin(list(dicts)), dict_id).otherwise("").alias("dict_id"), F.when(F.col("dict_class").isin(list(dicts)), F.col("dict_class")).otherwise("").alias("dict_class"))
    as_is.unionByName(packed).write.parquet(f"{temp}/chunks")

    sizes = spark.read.parquet(f"{temp}/chunks").select("chunk_hash", F.octet_length("data").cast("long").alias("body_length"), "compressed")
    per_file = spark.read.parquet(f"{temp}/refs").join(sizes, "chunk_hash").groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_hash", "body_length", F.col("length").alias("uncompressed_length"), "compressed"))).alias("chunks"))
    index = light.select("relative_path", "asset_type", "size", F.col("size").alias("uncompressed_length"), F.col("hash_hex").alias("content_hash"), pre_encoding(F.col("asset_type"), s.mesh_delta).alias("pre_encoding"), raw_flag.alias("is_stored_raw"), F.lit(0).cast("long").alias("compressed_length")).join(dups, "relative_path", "left").join(per_file, "relative_path", "left")
    index.withColumn("chunks", F.coalesce("chunks", F.from_json(F.lit("[]"), index.schema["chunks"].dataType.simpleString()))).write.parquet(f"{temp}/index")
    _write_manifest(spark, temp)
    for part in ("light", "dups", "raw", "marked"):
        delete(spark, f"{temp}/{part}")


def open_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a package; a missing table or a newer version is an error."""
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    version = tables["manifest"].select("version").first()
    if version is None or version[0] > VERSION:
        raise ValueError(f"not a package of version {VERSION} or before: {path}")
    return tables


def _windows(tables: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """``chunk_hash, window`` of stored chunks; null where a chunk is damaged or grows beyond its length.

    The dictionaries that a package names are as many as its builds, which a task
    may not be able to hold: chunks are read in turns, some dictionaries in each.
    """
    sizes = sorted((r["dict_id"], r["n"]) for r in tables["dicts"].groupBy("dict_id").agg(F.sum(F.octet_length("bytes")).alias("n")).collect())
    turns, held = [[""]], 0
    for name, n in sizes:
        if held and held + n > HELD_DICTS:
            turns.append([])
            held = 0
        turns[-1].append(name)
        held += n
    key = F.concat("dict_id", F.lit("/"), "dict_class")
    out = chunks.where("not compressed").select("chunk_hash", F.col("data").alias("window"))
    for names in turns:
        dicts = {f"{r['dict_id']}/{r['dict_class']}": bytes(r["bytes"]) for r in tables["dicts"].where(F.col("dict_id").isin(names)).collect()}
        some = chunks.where(F.col("compressed") & F.col("dict_id").isin(names))
        out = out.union(some.select("chunk_hash", codec.decompress("data", key, dicts, "length").alias("window")))
    return out


def _store(tables: dict[str, DataFrame], refs: DataFrame | None = None) -> DataFrame:
    """``chunk_hash, window, sound`` of the chunks that ``refs`` name, or of all."""
    used = tables["chunks"] if refs is None else tables["chunks"].join(refs.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
    return _windows(tables, used).withColumn("sound", F.coalesce(xxh3_64("window") == F.col("chunk_hash"), F.lit(False)))


def pieces(tables: dict[str, DataFrame], paths: DataFrame | None = None) -> DataFrame:
    """``relative_path, ordinal, start, window, sound``: the stored form of entries of any size, a row a chunk.

    Rows of a file in the order of ``ordinal`` are its bytes (of a mesh, their differences).
    """
    refs = tables["refs"] if paths is None else tables["refs"].join(paths, "relative_path", "left_semi")
    return refs.join(_store(tables, None if paths is None else refs), "chunk_hash", "left").select("relative_path", "ordinal", "start", "length", "window", F.coalesce("sound", F.lit(False)).alias("sound"))


def contents(tables: dict[str, DataFrame], paths: DataFrame | None = None, limit: int = BOMB_BYTES) -> DataFrame:
    """``relative_path, content, reason`` of each entry that stores bytes; content is null where a reason is given.

    Chunks are checked against their hashes, files against sizes and hashes.
    Entries of more than ``limit`` bytes, by their size or their chunks' lengths,
    are not decompressed.
    """
    index = tables["index"].where("duplicate_of is null")
    if paths is not None:
        index = index.join(paths, "relative_path", "left_semi")
    refs = tables["refs"].join(index.select("relative_path"), "relative_path", "left_semi")
    grown = refs.groupBy("relative_path").agg(F.sum("length").alias("grown"))
    index = index.join(grown, "relative_path", "left").withColumn("bomb", F.greatest(F.col("size"), F.coalesce("grown", F.lit(0))) > limit)
    joined = pieces(tables, index.where("not bomb").select("relative_path"))
    piece = F.struct("ordinal", F.hex("window").alias("piece"))
    whole = joined.groupBy("relative_path").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.count_if(~F.col("sound")).alias("bad"))
    joined = index.select("relative_path", "size", "content_hash", "pre_encoding", "bomb").join(whole, "relative_path", "left")
    body = F.when(~F.col("bomb") & (F.coalesce("bad", F.lit(0)) == 0), F.unhex(F.coalesce(F.array_join(F.col("p.piece"), ""), F.lit(""))))
    rows = joined.select("relative_path", "size", "content_hash", "pre_encoding", "bomb", body.alias("content"))
    coded = rows.where("pre_encoding <> 'None'").withColumn("content", decode_bytes("content"))
    rows = rows.where("pre_encoding = 'None'").unionByName(coded)
    reason = F.when(F.col("bomb"), "larger than the limit").when(F.col("content").isNull(), "damaged chunk").when(F.octet_length("content") != F.col("size"), "size mismatch").when(F.md5("content") != F.col("content_hash"), "hash mismatch")
    return rows.select("relative_path", F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("reason"))


def verify(tables: dict[str, DataFrame]) -> DataFrame:
    """``relative_path, ok, reason`` of each entry that stores bytes, of any size."""
    return _checked(tables, tables["index"].where("duplicate_of is null"), None)


def extract_to(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Write all entries, of any size, below ``root``, a folder that executors share: ``relative_path, ok, reason``."""
    return _checked(tables, tables["index"], root)


def _checked(tables: dict[str, DataFrame], index: DataFrame, root: str | None) -> DataFrame:
    """Entries checked against size and hash chunk by chunk, and written below ``root`` if it is given.

    A file's chunks go to one task in their order, which holds a batch of them
    and never the file; a copy is written from its original's chunks.  A file
    takes its name once it is whole, so a task may run again.
    """
    source = F.coalesce("duplicate_of", "relative_path")
    entries = index.select("relative_path", source.alias("source"), "size", "content_hash", is_safe_relative(F.col("relative_path")).alias("safe"))
    stored = tables["index"].select(F.col("relative_path").alias("source"), (F.col("pre_encoding") != "None").alias("coded"))
    refs = tables["refs"].select(F.col("relative_path").alias("source"), "ordinal", "chunk_hash")
    rows = entries.join(stored, "source").join(refs, "source", "left")
    rows = rows.join(_store(tables), "chunk_hash", "left").repartition("relative_path").sortWithinPartitions("relative_path", "ordinal")
    return rows.select("relative_path", "size", "content_hash", "safe", "coded", "ordinal", "window", "sound").mapInArrow(partial(_check_files, root), VERDICT)


VERDICT = "relative_path string, ok boolean, reason string"


def _verdicts(rows: list[tuple[str, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([r is None for _, r in rows], pa.bool_()), pa.array([r for _, r in rows], pa.string())], ["relative_path", "ok", "reason"])


def _place(root: str, path: str) -> str:
    """The file's name below ``root``, with the folders above it made; a symbolic link on the way is an error."""
    parent = root
    for part in path.split("/")[:-1]:
        parent = os.path.join(parent, part)
        if os.path.islink(parent):
            raise OSError("symbolic link on the way")
    os.makedirs(parent, exist_ok=True)
    return os.path.join(root, *path.split("/"))


class _File:
    """A file that is checked, and written where there is a root, as its chunks come."""

    def __init__(self, root: str | None, path: str, size: int, content_hash: str, safe: bool, coded: bool):
        self.path, self.size, self.hash = path, size, content_hash
        self.sum, self.seen = hashlib.md5(usedforsecurity=False), 0
        self.decoder = BufferDecoder() if coded else None
        self.reason = None if safe else "unsafe path"
        self.out = self.target = None
        if root is not None and safe:
            try:
                self.target = _place(root, path)
                self.out = open(f"{self.target}.{uuid.uuid4().hex}.part", "wb")
            except OSError as error:
                self.reason = str(error)

    def add(self, ordinal: int | None, window: bytes | None, sound: bool | None) -> None:
        if ordinal is not None and not sound:
            self.reason = self.reason or "damaged chunk"
        elif ordinal is not None and self.reason is None:
            self._take(self.decoder.part(window) if self.decoder else window)

    def _take(self, data: bytes) -> None:
        self.sum.update(data)
        self.seen += len(data)
        if self.seen > self.size:
            self.reason = "size mismatch"
        elif self.out is not None:
            try:
                self.out.write(data)
            except OSError as error:
                self.reason = str(error)

    def end(self) -> tuple[str, str | None]:
        if self.decoder and self.reason is None:
            self._take(self.decoder.end())
        if self.reason is None:
            self.reason = "size mismatch" if self.seen != self.size else "hash mismatch" if self.sum.hexdigest() != self.hash else None
        if self.out is not None:
            try:
                self.out.close()
                if self.reason is None:
                    os.replace(self.out.name, self.target)
                else:
                    os.remove(self.out.name)
            except OSError as error:
                self.reason = self.reason or str(error)
        return self.path, self.reason


def _check_files(root: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        done = []
        heads = zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)
        for k, (path, size, content_hash, safe, coded, ordinal) in enumerate(heads):
            if now is None or now.path != path:
                if now is not None:
                    done.append(now.end())
                now = _File(root, path, size, content_hash, safe, coded)
            now.add(ordinal, batch.column(6)[k].as_py(), batch.column(7)[k].as_py())
        yield _verdicts(done)
    if now is not None:
        yield _verdicts([now.end()])


def extract_all(tables: dict[str, DataFrame]) -> DataFrame:
    """``relative_path, content, reason`` of all entries, duplicates with their original's bytes; unsafe paths fail."""
    index = tables["index"].select("relative_path", F.coalesce("duplicate_of", "relative_path").alias("source"))
    found = contents(tables).withColumnRenamed("relative_path", "source")
    out = index.join(found, "source", "left")
    unsafe = ~is_safe_relative(F.col("relative_path"))
    return out.select("relative_path", F.when(~unsafe, F.col("content")).alias("content"), F.when(unsafe, "unsafe path").otherwise(F.col("reason")).alias("reason"))


def extract_file(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """``name, content`` of one file; the name is that of the entry which stores the bytes.  A path outside the index is an error."""
    entry = tables["index"].where(F.col("relative_path") == path).select("duplicate_of").first()
    if entry is None:
        raise KeyError(path)
    source = entry["duplicate_of"] or path
    one = tables["index"].sparkSession.createDataFrame([(source,)], "relative_path string")
    return contents(tables, one).select(basename(F.col("relative_path")).alias("name"), "content", "reason")


def write_files(extracted: DataFrame, root: str) -> DataFrame:
    """Write extracted files below ``root``, a folder that executors share; ``relative_path, ok, reason``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, reason in zip(*(batch.column(c).to_pylist() for c in ("relative_path", "content", "reason")), strict=True):
                if reason is None:
                    try:
                        target = _place(root, path)
                        temp = f"{target}.{uuid.uuid4().hex}.part"
                        with open(temp, "wb") as file:
                            file.write(content)
                        os.replace(temp, target)
                    except OSError as error:
                        reason = str(error)
                rows.append((path, reason))
            yield _verdicts(rows)

    return extracted.mapInArrow(run, VERDICT)


def build_incremental(assets: DataFrame, previous: str, path: str, settings: Settings | None = None, cdc: tuple[int, int, int] = (CDC_MIN, CDC_AVG, CDC_MAX)) -> DataFrame:
    """Write a package that takes over unchanged files' chunks from ``previous``; returns the plan.

    Taken-over chunks keep their dictionaries, which are copied with them.
    Where ``previous`` is missing or no package, everything is built anew.
    """
    spark = assets.sparkSession
    try:
        old = open_package(spark, previous)
    except (AnalysisException, ValueError):
        build(assets, path, settings, cdc)
        return assets.select("relative_path", "size", F.lit("recompress").alias("action"))
    plan = incremental_plan(assets, old["index"].select("relative_path", "size", F.col("content_hash").alias("hash_hex")))
    plan = plan.persist()
    with published(spark, path) as temp:
        _build(assets.join(plan.where("action = 'recompress'"), "relative_path", "left_semi"), f"{temp}/new", settings or Settings(), cdc)
        _take_over(spark, old, plan, temp)
    return plan


def _take_over(spark: SparkSession, old: dict[str, DataFrame], plan: DataFrame, temp: str) -> None:
    """Joins what is new, below ``temp``/new, with what the plan takes over; dictionaries that no chunk names end here."""
    fresh = open_package(spark, f"{temp}/new")
    reused = plan.where("action = 'reuse'").select("relative_path")
    index = old["index"].join(reused, "relative_path", "left_semi")
    # a kept duplicate whose original is gone or changed becomes an entry with chunks of its own
    kept_original = index.select(F.col("relative_path").alias("duplicate_of"), F.lit(True).alias("there"))
    index = index.join(kept_original, "duplicate_of", "left")
    orphans = index.where("duplicate_of is not null and there is null").select("relative_path")
    moved = old["index"].join(orphans, "relative_path", "left_semi").select(F.col("duplicate_of").alias("from"), F.col("relative_path").alias("to"))
    own_refs = old["refs"].join(reused, "relative_path", "left_semi")
    moved_refs = old["refs"].join(moved, F.col("relative_path") == F.col("from")).select(F.col("to").alias("relative_path"), "ordinal", "chunk_hash", "start", "length")
    # such a copy takes over how its original was stored, which may be of another type
    how = ["pre_encoding", "is_stored_raw", "chunks"]
    source = old["index"].select(F.col("relative_path").alias("from"), *(F.col(c).alias(f"__{c}") for c in how))
    index = index.join(moved.join(source, "from").drop("from").withColumnRenamed("to", "relative_path").withColumn("orphan", F.lit(True)), "relative_path", "left")
    index = index.withColumns({c: F.when(F.col("orphan"), F.col(f"__{c}")).otherwise(F.col(c)) for c in how} | {"duplicate_of": F.when(F.col("orphan").isNull(), F.col("duplicate_of"))}).select(fresh["index"].columns)
    refs = own_refs.unionByName(moved_refs)
    fresh["index"].unionByName(index).write.parquet(f"{temp}/index")
    fresh["refs"].unionByName(refs).write.parquet(f"{temp}/refs")
    needed = refs.select("chunk_hash").distinct().join(fresh["chunks"].select("chunk_hash"), "chunk_hash", "left_anti")
    fresh["chunks"].unionByName(old["chunks"].join(needed, "chunk_hash", "left_semi")).write.parquet(f"{temp}/chunks")
    named = spark.read.parquet(f"{temp}/chunks").select("dict_id", "dict_class").distinct()
    fresh["dicts"].unionByName(old["dicts"]).join(named, ["dict_id", "dict_class"], "left_semi").write.parquet(f"{temp}/dicts")
    _write_manifest(spark, temp)
    delete(spark, f"{temp}/new")


def sign(spark: SparkSession, path: str, private: bytes, public: bytes) -> None:
    """Sign the tables; a signature that is there is replaced."""
    signature = Ed25519(spark).sign(private, _digest(spark, path))
    fs, target = _fs(spark, f"{path}/signature.json")
    stream = fs.create(target, True)
    try:
        stream.write(json.dumps({"public": public.hex(), "signature": signature.hex()}).encode())
    finally:
        stream.close()


def verify_signature(spark: SparkSession, path: str, expected: bytes | None = None) -> bytes:
    """The key that signed the package; unsigned, changed or other than ``expected`` is an error."""
    fs, target = _fs(spark, f"{path}/signature.json")
    if not fs.exists(target):
        raise ValueError("not signed")
    block = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/signature.json").collect()))
    public = bytes.fromhex(block["public"])
    if not Ed25519(spark).verify(public, _digest(spark, path), bytes.fromhex(block["signature"])):
        raise ValueError("the signature does not fit the contents")
    if expected is not None and expected != public:
        raise ValueError("signed with another key")
    return public


def _digest(spark: SparkSession, path: str) -> bytes:
    tables = open_package(spark, path)
    return b"".join(table_digest(tables[t]) for t in TABLES)
