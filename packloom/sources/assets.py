"""Assets: one row per file with its path, type, size, hash and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.classify import asset_type
from ..functions.hashing import xxh3_64
from ..functions.paths import relative_to

SCHEMA = "path string, relative_path string, asset_type string, size long, hash long, hash_hex string, content binary"
#: Files that a task of a scan reads at most.
FILES_OF_A_SPLIT = 1_000
#: Extensions that stand in for files in tables without any, by id.
DOCUMENT_EXT = ["png", "obj", "ogg", "txt"]


def _root_uri(spark: SparkSession, root: str) -> str:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of no bytes, which the binary reader leaves out; from a listing, no file is opened.

    The JVM sorts each folder's entries, folders first and files by size, so only
    folders and empty files cost calls from here.
    """
    jvm = spark.sparkContext._jvm
    start = jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    kind, find = jvm.java.lang.Class.forName, jvm.java.lang.invoke.MethodHandles.publicLookup().findVirtual

    def getter(interface: str, name: str, result):
        handle = find(kind("org.apache.hadoop.fs.FileStatus"), name, jvm.java.lang.invoke.MethodType.methodType(result))
        return jvm.java.lang.invoke.MethodHandleProxies.asInterfaceInstance(kind(interface), handle)

    by_size = jvm.java.util.Comparator.comparingLong(getter("java.util.function.ToLongFunction", "getLen", jvm.java.lang.Long.TYPE))
    folders_first = jvm.java.util.Comparator.comparing(getter("java.util.function.Function", "isFile", jvm.java.lang.Boolean.TYPE))
    found, todo = [], [start]
    while todo:
        # a status with a location would ask the system for each local file's owner
        entries = jvm.org.apache.hadoop.util.functional.RemoteIterators.toList(fs.listStatusIterator(todo.pop()))
        jvm.java.util.Collections.sort(entries, by_size)
        jvm.java.util.Collections.sort(entries, folders_first)
        for k in range(entries.size()):
            status = entries.get(k)
            if status.isDirectory():
                todo.append(status.getPath())
            elif status.getLen() == 0:
                found.append((status.getPath().toString(), status.getModificationTime() * 1_000_000))
            else:
                break
    return spark.createDataFrame(found, "path string, mtime_nanos long")


def describe(files: DataFrame, root: str, *, xxh3: bool = True) -> DataFrame:
    """``path, content`` to the columns of ``SCHEMA``, and ``mtime_nanos`` where there is one."""
    relative = relative_to(F.col("path"), root)
    return files.select("path", relative.alias("relative_path"), asset_type(relative, F.col("content")).alias("asset_type"), F.octet_length("content").cast("long").alias("size"), (xxh3_64("content") if xxh3 else F.lit(None).cast("long")).alias("hash"), F.md5("content").alias("hash_hex"), "content", *(["mtime_nanos"] if "mtime_nanos" in files.columns else []))


def scan_assets(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``, empty ones included.

    Unreadable files are left out, as with ``ignoreCorruptFiles``; a file has to
    fit into one binary value.
    """
    uri = _root_uri(spark, root)
    # opening a file counts for little beside a split's bytes; settings of a session of its own hold for this reader only
    own, size = spark.newSession(), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    own.conf.set("spark.sql.files.maxPartitionBytes", size)
    own.conf.set("spark.sql.files.openCostInBytes", max(1, size // FILES_OF_A_SPLIT))
    files = own.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root).select("path", "content", (F.unix_micros("modificationTime") * 1_000).alias("mtime_nanos"))
    none = empty_files(spark, root).select("path", F.lit(b"").alias("content"), "mtime_nanos")
    # the reader and the listing may write the scheme of a local path in two ways
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return describe(none.select("path", "content", "mtime_nanos").union(files).select(plain(F.col("path")).alias("path"), "content", "mtime_nanos"), uri.replace("file:///", "file:/"))


def documents_as_assets(docs: DataFrame) -> DataFrame:
    """Texts as files ``lang/source/doc_<id>.<ext>``; hashes are MD5, so results can be checked in SQL."""
    ext = F.element_at(F.array(*map(F.lit, DOCUMENT_EXT)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    rows = docs.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    return describe(rows, "", xxh3=False)


def pages_as_assets(pages: DataFrame) -> DataFrame:
    """Pages as files named by their address."""
    return describe(pages.select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content")), "", xxh3=False)


def old_version(docs: DataFrame) -> DataFrame:
    """An earlier state of ``documents`` for comparing versions: every tenth is missing."""
    return docs.where(F.pmod("doc_id", F.lit(10)) != 0)


def new_version(docs: DataFrame) -> DataFrame:
    """A later state: every seventh is gone and every fifth has changed."""
    text = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    return docs.where(F.pmod("doc_id", F.lit(7)) != 0).withColumn("text", text)


def content_range(df: DataFrame, offset: int, length: int, content: str = "content") -> DataFrame:
    """Bytes ``offset .. offset + length`` of each file."""
    return df.withColumn("range", F.substring(content, offset + 1, length))
