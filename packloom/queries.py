"""Queries over the driver tables, one or more for each operator, and their DuckDB counterparts.

``documents`` stand for files (see ``sources.assets``).  Window and block sizes are
smaller than the defaults, because texts are smaller than game assets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import classify, delta, numbers, paths
from .functions.hashing import unsigned, xxh3_64
from .operators import chunks, codec, duplicates, integrity, listing, ordering, patterns, similarity, versions, windows
from .plans import analyze as analyze_plan, benchmark, package, patch
from .sources import assets as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BLOCK, WINDOW, STRIDE, LEAST = 256, 64, 16, 2
CDC = (256, 1_024, 4_096)

_ASSETS = """
assets AS (
  SELECT *, lang || '/' || source || '/doc_' || doc_id || '.' || ext AS relative_path, md5(text) AS hash_hex, hex(encode(text)) AS hx,
         CAST(octet_length(encode(text)) AS BIGINT) AS size,
         CASE ext WHEN 'png' THEN 'Texture' WHEN 'obj' THEN 'Mesh' WHEN 'ogg' THEN 'Audio' ELSE 'Unknown' END AS asset_type
  FROM (SELECT *, (['png', 'obj', 'ogg', 'txt'])[CAST(doc_id % 4 + 1 AS INT)] AS ext FROM documents))"""
_CLUSTERS = """
clusters AS (
  SELECT size, hash_hex, count(*) AS n_paths, list_aggregate(min(string_split(relative_path, '/')), 'string_agg', '/') AS original
  FROM assets GROUP BY ALL HAVING count(*) > 1),
dups AS (SELECT a.relative_path, c.original AS duplicate_of FROM assets a JOIN clusters c USING (size, hash_hex) WHERE a.relative_path <> c.original)"""
_BLOCKS = f"""
blocks AS (
  SELECT relative_path, CAST(o AS INT) AS ordinal, md5(substr(hx, CAST(o * {2 * BLOCK} + 1 AS BIGINT), {2 * BLOCK})) AS chunk_hash,
         CAST(length(substr(hx, CAST(o * {2 * BLOCK} + 1 AS BIGINT), {2 * BLOCK})) / 2 AS BIGINT) AS length
  FROM (SELECT relative_path, hx, unnest(generate_series(0, CAST(ceil(size / {BLOCK}.0) AS BIGINT) - 1)) AS o FROM assets WHERE size > 0))"""
_REFS = """
refs AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY string_split(relative_path, '/'), ordinal) = 1 AS stored FROM blocks)"""
_VERSIONS = """
old_docs AS (SELECT * FROM documents WHERE doc_id % 10 <> 0),
new_docs AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' (revised)' ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id % 7 <> 0)"""
_DIFF = """
diff AS (
  SELECT coalesce(o.relative_path, n.relative_path) AS relative_path,
         CASE WHEN o.relative_path IS NULL THEN 'Added' WHEN n.relative_path IS NULL THEN 'Removed' WHEN o.hash_hex = n.hash_hex THEN 'Unchanged' ELSE 'Modified' END AS kind,
         o.size AS old_size, n.size AS new_size
  FROM old_assets o FULL JOIN new_assets n ON o.relative_path = n.relative_path)"""
_INDEX = """
idx AS (
  SELECT a.relative_path, a.asset_type, a.size, d.duplicate_of, a.ext IN ('png', 'ogg') AS is_stored_raw, coalesce(b.held, 0) AS held
  FROM assets a LEFT JOIN dups d ON a.relative_path = d.relative_path
  LEFT JOIN (SELECT relative_path, CAST(sum(length) AS BIGINT) AS held FROM blocks GROUP BY 1) b ON a.relative_path = b.relative_path),
listed AS (
  SELECT relative_path AS path, asset_type, size AS uncompressed_bytes, CASE WHEN duplicate_of IS NOT NULL THEN 0 ELSE held END AS compressed_bytes,
         CASE WHEN duplicate_of IS NOT NULL OR held = 0 THEN 0.0 ELSE CAST(size AS DOUBLE) / held END AS ratio,
         duplicate_of IS NOT NULL AS is_duplicate, is_stored_raw, duplicate_of FROM idx)"""


def _versions_as(of: str, name: str) -> str:
    return _ASSETS.replace("assets AS", f"{name} AS").replace("FROM documents", f"FROM {of}")


def _blocks_of(assets: str, name: str) -> str:
    return _BLOCKS.replace("blocks AS", f"{name} AS").replace("FROM assets", f"FROM {assets}")


def _sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ordering.spread(spark.read.parquet(f"{d}/{name}.parquet"))


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return sources.documents_as_assets(_table(spark, d, "documents"))


def _light(spark: SparkSession, d: str) -> DataFrame:
    """Assets without their bytes: what most operators shuffle."""
    return _assets(spark, d).drop("content")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.fixed_chunks(_assets(spark, d), BLOCK)


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, d, "documents")
    return sources.documents_as_assets(sources.old_version(docs)), sources.documents_as_assets(sources.new_version(docs))


def _index(spark: SparkSession, d: str) -> DataFrame:
    """An index of fixed blocks stored as they are, as one entry a file."""
    a = _light(spark, d)
    held = _blocks(spark, d).groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_hash", F.col("length").alias("body_length")))).alias("chunks"))
    index = a.join(duplicates.duplicate_map(a), "relative_path", "left").join(held, "relative_path", "left")
    index = index.withColumn("chunks", F.coalesce("chunks", F.array().cast(index.schema["chunks"].dataType)))
    return index.withColumn("uncompressed_length", F.col("size")).withColumn("compressed_length", F.lit(0).cast("long")).withColumn("is_stored_raw", classify.stored_raw(F.col("asset_type"), F.col("relative_path")))


# Scans and projections

@query(_sql(_ASSETS, select="SELECT relative_path, asset_type, size, hash_hex FROM assets"))
def a1_scan_assets(spark, d):
    return _light(spark, d).select("relative_path", "asset_type", "size", "hash_hex")


@query("SELECT url AS relative_path, CAST(octet_length(encode(html)) AS BIGINT) AS size, md5(html) AS hash_hex FROM pages")
def a2_scan_pages(spark, d):
    return sources.pages_as_assets(_table(spark, d, "pages")).select("relative_path", "size", "hash_hex")


@query()
def a3_xxh3(spark, d):
    return _assets(spark, d).select("relative_path", unsigned(xxh3_64("content")).alias("hash"))


@query(_sql(_ASSETS, select="SELECT relative_path, rpad(substr(hx, 1, 32), 32, '0') AS magic FROM assets"))
def a4_magic(spark, d):
    return _assets(spark, d).select("relative_path", F.hex(classify.magic(F.col("content"))).alias("magic"))


@query(_sql(_ASSETS, select="SELECT relative_path, asset_type, size, 0 AS n_chunks, false AS is_stored_raw FROM assets"))
def a6_upgrade_index(spark, d):
    old = _light(spark, d).select("relative_path", "asset_type", "size")
    now = spark.createDataFrame([], "relative_path string, asset_type string, size long, n_chunks int, is_stored_raw boolean")
    return old.unionByName(now, allowMissingColumns=True).select("relative_path", "asset_type", "size", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("is_stored_raw", F.lit(False)).alias("is_stored_raw"))


@query(_sql(_ASSETS, select="SELECT relative_path, substr(hx, 33, 64) AS range_hex FROM assets"))
def a9_content_range(spark, d):
    return sources.content_range(_assets(spark, d), 16, 32).select("relative_path", F.hex("range").alias("range_hex"))


@query(_sql(_ASSETS, select="SELECT relative_path, NOT (contains(relative_path, '..') OR doc_id % 3 = 1 OR doc_id % 3 = 2) AS safe, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '../' ELSE '/' END || relative_path AS target FROM assets"))
def b6_safe_path(spark, d):
    # every third path climbs out, every third is absolute
    docs = _table(spark, d, "documents")
    a = sources.documents_as_assets(docs).select("relative_path", F.regexp_extract("relative_path", r"doc_(\d+)", 1).cast("long").alias("n"))
    target = F.concat(F.when(F.col("n") % 3 == 0, "").when(F.col("n") % 3 == 1, "../").otherwise("/"), "relative_path")
    return a.select("relative_path", paths.is_safe_relative(target).alias("safe"), target.alias("target"))


@query(_sql(_ASSETS, select="""SELECT '{"relative_path":"' || relative_path || '","size":' || size || '}' AS json FROM assets"""))
def b10_json(spark, d):
    return analyze_plan.as_json(_light(spark, d).select("relative_path", "size"))


_MAGICS = ["89504E470D0A1A0A", "FFD8FF00", "44445320", "AB4B5458203230BB0D0A1A0A", "676C5446", "4F676753", "664C6143", "524946460000000057415645", "524946460000000041564920", "494433", "FFFB", "FFFE", "FFD0", "00"]


@query(
    _sql(
        _ASSETS,
        f"made AS (SELECT relative_path, ({_MAGICS!r})[CAST(doc_id % {len(_MAGICS)} + 1 AS INT)] || hx AS h, ext FROM assets)",
        select="""SELECT relative_path, CASE WHEN h LIKE '89504E470D0A1A0A%' OR h LIKE 'FFD8FF%' OR h LIKE '44445320%' OR h LIKE 'AB4B5458203230BB0D0A1A0A%' OR h LIKE 'AB4B5458203131BB0D0A1A0A%' THEN 'Texture'
        WHEN h LIKE '676C5446%' THEN 'Mesh'
        WHEN h LIKE '4F676753%' OR h LIKE '664C6143%' OR (h LIKE '52494646%' AND substr(h, 17, 8) = '57415645') OR h LIKE '494433%' OR h LIKE 'FFE%' OR h LIKE 'FFF%' THEN 'Audio' END AS by_magic FROM made""",
    )
)
def c1_classify_by_magic(spark, d):
    a = _assets(spark, d).withColumn("n", F.regexp_extract("relative_path", r"doc_(\d+)", 1).cast("long"))
    head = F.element_at(F.array(*map(F.lit, _MAGICS)), (F.col("n") % len(_MAGICS) + 1).cast("int"))
    return a.select("relative_path", classify.type_by_magic(F.unhex(F.concat(head, F.hex("content")))).alias("by_magic"))


@query("""SELECT url AS path, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\\.([^.]*)$', 1)) AS ext,
  CASE WHEN ext IN ('png','jpg','jpeg','tga','dds','ktx','ktx2','hdr','exr') THEN 'Texture' WHEN ext IN ('fbx','obj','gltf','glb','mesh','dae','blend') THEN 'Mesh'
       WHEN ext IN ('wav','ogg','mp3','flac','aac','m4a','opus') THEN 'Audio' ELSE 'Unknown' END AS by_ext FROM pages""")
def c2_classify_by_ext(spark, d):
    url = F.col("url")
    return _table(spark, d, "pages").select(url.alias("path"), paths.extension(url).alias("ext"), classify.type_by_extension(url).alias("by_ext"))


_ROLE_SQL = "CASE WHEN p LIKE '%normal%' OR p LIKE '%nrm%' THEN 'Normal' WHEN p LIKE '%rough%' OR p LIKE '%rgh%' THEN 'Roughness' WHEN p LIKE '%metal%' OR p LIKE '%spec%' THEN 'Metallic' WHEN p LIKE '%albedo%' OR p LIKE '%diffuse%' OR p LIKE '%basecolor%' THEN 'Albedo' ELSE 'Unknown' END"
_ROLE_NAMES = ["rock_Normal", "rock_nrm", "RoughWall", "metal_spec", "albedo", "Diffuse", "basecolor_x", "plain"]


@query(
    f"""WITH named AS (SELECT doc_id, ({_ROLE_NAMES!r})[CAST(doc_id % 8 + 1 AS INT)] || '/' || source AS path, (['Texture', 'Mesh', 'Audio', 'Unknown'])[CAST(doc_id % 4 + 1 AS INT)] AS kind FROM documents),
    low AS (SELECT *, lower(path) AS p FROM named)
    SELECT doc_id, {_ROLE_SQL} AS role, CASE WHEN kind = 'Texture' THEN 'texture/' || {_ROLE_SQL} ELSE lower(kind) END AS class FROM low"""
)
def c3_c4_texture_role(spark, d):
    docs = _table(spark, d, "documents")
    path = F.concat(F.element_at(F.array(*map(F.lit, _ROLE_NAMES)), (F.col("doc_id") % 8 + 1).cast("int")), F.lit("/"), "source")
    kind = F.element_at(F.array(*map(F.lit, classify.TYPES)), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select("doc_id", classify.texture_role(path).alias("role"), classify.asset_class(kind, path).alias("class"))


@query(
    _sql(
        _ASSETS,
        select="""SELECT relative_path, ext IN ('png', 'ogg') AS stored_raw, CASE asset_type WHEN 'Texture' THEN 9 WHEN 'Audio' THEN 1 ELSE 3 END AS level,
        CASE WHEN asset_type = 'Mesh' THEN 'DeltaBytes' ELSE 'None' END AS pre_encoding, CASE WHEN asset_type IN ('Texture', 'Mesh') THEN lower(asset_type) ELSE 'other' END AS dict_class FROM assets""",
    )
)
def c5_c6_c7_c20_choices(spark, d):
    kind, path = F.col("asset_type"), F.col("relative_path")
    return _light(spark, d).select("relative_path", classify.stored_raw(kind, path).alias("stored_raw"), classify.codec_level(kind).alias("level"), classify.pre_encoding(kind).alias("pre_encoding"), classify.dict_class(kind).alias("dict_class"))


_WORDS_SQL = "SELECT doc_id, substr(hx, CAST(size // 4 * 8 + 1 AS BIGINT), 6) AS tail, list_transform(generate_series(0, CAST(size // 4 AS BIGINT) - 1), lambda i: CAST(('0x' || substr(hx, CAST(i * 8 + 7 AS BIGINT), 2) || substr(hx, CAST(i * 8 + 5 AS BIGINT), 2) || substr(hx, CAST(i * 8 + 3 AS BIGINT), 2) || substr(hx, CAST(i * 8 + 1 AS BIGINT), 2)) AS BIGINT)) AS w FROM assets"


def _words(spark, d):
    """The little-endian words of each whole file, and the bytes after the last whole word."""
    a = _assets(spark, d).withColumn("doc_id", F.regexp_extract("relative_path", r"doc_(\d+)", 1).cast("long"))
    n = F.floor(F.octet_length("content") / 4).cast("int")
    at = lambda i, k: F.substring(F.hex(F.substring(F.col("content"), i * 4 + 1, F.lit(4))), 2 * k + 1, 2)
    words = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.concat(at(i, 3), at(i, 2), at(i, 1), at(i, 0)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return a.select("doc_id", words.alias("w"), F.hex(F.substring(F.col("content"), n * 4 + 1, F.lit(3))).alias("tail"))


@query(_sql(_ASSETS, f"words AS ({_WORDS_SQL})", select="SELECT doc_id, array_to_string(list_transform(w, lambda x, i: (x - CASE WHEN i = 1 THEN 0 ELSE w[i - 1] END + 4294967296) % 4294967296), ',') AS deltas, tail FROM words"))
def c8_delta_words(spark, d):
    return _words(spark, d).select("doc_id", F.concat_ws(",", delta.encode_words(F.col("w")).cast("array<string>")).alias("deltas"), "tail")


@query(_sql(_ASSETS, f"words AS ({_WORDS_SQL})", select="SELECT doc_id, array_to_string(w, ',') AS words, tail FROM words"))
def c9_delta_decode_words(spark, d):
    coded = _words(spark, d).select("doc_id", delta.encode_words(F.col("w")).alias("c"), "tail")
    return coded.select("doc_id", F.concat_ws(",", delta.decode_words(F.col("c")).cast("array<string>")).alias("words"), "tail")


@query(_sql(_ASSETS, select="SELECT relative_path, true AS same FROM assets"))
def c8_c9_delta_bytes(spark, d):
    a = _assets(spark, d).withColumn("coded", delta.encode_bytes("content"))
    return a.select("relative_path", (delta.decode_bytes("coded") == F.col("content")).alias("same"))


_QUANT = "list_transform(embedding, lambda v: CAST(trunc(v * CAST(1024 AS FLOAT)) AS BIGINT))"


@query(f"WITH q AS (SELECT vec_id, {_QUANT} AS w FROM embeddings) SELECT vec_id, array_to_string(list_transform(w, lambda x, i: x - CASE WHEN i = 1 THEN 0 ELSE w[i - 1] END), ',') AS deltas FROM q")
def c10_delta_vertices(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", F.concat_ws(",", delta.encode_vertices(F.col("embedding")).cast("array<string>")).alias("deltas"))


@query(f"WITH q AS (SELECT vec_id, {_QUANT} AS w FROM embeddings) SELECT vec_id, list_sum(list_transform(w, lambda x: x / 1024.0::DOUBLE)) AS total, w[64] / 1024.0::DOUBLE AS last FROM q")
def c11_decode_vertices(spark, d):
    coded = _table(spark, d, "embeddings").select("vec_id", delta.encode_vertices(F.col("embedding")).alias("c"))
    back = coded.select("vec_id", delta.decode_vertices(F.col("c")).alias("v"))
    return back.select("vec_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.element_at("v", 64).cast("double").alias("last"))


@query(
    _sql(
        _ASSETS,
        select="""SELECT relative_path, CASE WHEN size % 7 = 0 THEN 0.0 ELSE CAST(size AS DOUBLE) / (size % 7) END AS ratio, CAST(size AS DOUBLE) / 100000 * 100 AS pct,
        least(CAST(size AS DOUBLE) / 5000, 1.0) AS done, lower(substr(hx, 1, 16)) AS head,
        CASE WHEN length(relative_path) > 20 THEN '…' || right(relative_path, 19) ELSE relative_path END AS shown, regexp_replace(relative_path, '\\.[^./]*$', '') || '.manifest' AS sidecar,
        printf('%.1f MB', size / 1048576.0) AS mb FROM assets""",
    )
)
def c12_c22_report_scalars(spark, d):
    size, path = F.col("size"), F.col("relative_path")
    return _assets(spark, d).select("relative_path", numbers.ratio(size, size % 7).alias("ratio"), numbers.percent(size, F.lit(100000)).alias("pct"), numbers.fraction_done(size, F.lit(5000)).alias("done"), numbers.hex_lower(F.substring("content", 1, 8)).alias("head"), paths.ellipsis(path, 20).alias("shown"), paths.sidecar(path, "manifest").alias("sidecar"), numbers.megabytes(size).alias("mb"))


# Duplicates

@query(_sql(_ASSETS, _CLUSTERS, select="SELECT size, hash_hex, n_paths, original FROM clusters"))
def e1_exact_duplicates(spark, d):
    return duplicates.clusters(_light(spark, d))


@query(_sql(_ASSETS, _CLUSTERS, select="SELECT count(*) AS clusters, CAST(coalesce(sum(n_paths - 1), 0) AS BIGINT) AS duplicate_files, CAST(coalesce(sum(size * (n_paths - 1)), 0) AS BIGINT) AS wasted_bytes FROM clusters"))
def e2_duplicate_waste(spark, d):
    return duplicates.waste(duplicates.clusters(_light(spark, d)))


@query(_sql(_ASSETS, select="SELECT t.asset_type, count(a.size) AS files, CAST(coalesce(sum(a.size), 0) AS BIGINT) AS bytes FROM (VALUES ('Texture'), ('Mesh'), ('Audio'), ('Unknown')) t(asset_type) LEFT JOIN assets a USING (asset_type) GROUP BY 1"))
def e3_type_breakdown(spark, d):
    return duplicates.type_breakdown(_light(spark, d))


@query(_sql(_ASSETS, select="SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM assets"))
def e4_e15_totals(spark, d):
    return duplicates.totals(_light(spark, d))


@query(_sql(_ASSETS, _CLUSTERS, select="SELECT relative_path, duplicate_of FROM dups"))
def f1_first_in_cluster(spark, d):
    return duplicates.duplicate_map(_light(spark, d))


@query(_sql(_ASSETS, _CLUSTERS, select="SELECT relative_path, size FROM assets WHERE relative_path NOT IN (SELECT relative_path FROM dups)"))
def d1_to_compress(spark, d):
    return duplicates.originals(_light(spark, d)).select("relative_path", "size")


@query(_sql(_ASSETS, _CLUSTERS, select="SELECT a.relative_path, coalesce(o.asset_type, a.asset_type) AS asset_type, coalesce(o.size, a.size) AS size FROM assets a LEFT JOIN dups d ON a.relative_path = d.relative_path LEFT JOIN assets o ON o.relative_path = d.duplicate_of"))
def d8_resolve_duplicates(spark, d):
    a = _light(spark, d).select("relative_path", "asset_type", "size")
    index = a.join(duplicates.duplicate_map(_light(spark, d)), "relative_path", "left")
    return duplicates.resolve(index, ["asset_type", "size"]).select("relative_path", "asset_type", "size")


@query(_sql(_ASSETS, select="SELECT relative_path, size FROM assets WHERE relative_path = 'en/src1/doc_21.obj'"))
def d9_point_lookup(spark, d):
    return listing.find(_light(spark, d), "en/src1/doc_21.obj").select("relative_path", "size")


@query(_sql(_ASSETS, select="SELECT relative_path, row_number() OVER (ORDER BY string_split(relative_path, '/')) - 1 AS position, coalesce(CAST(sum(size) OVER (ORDER BY string_split(relative_path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS bytes_before FROM assets"))
def f6_g2_path_order(spark, d):
    placed = ordering.with_positions(_light(spark, d).select("relative_path", "size"), [paths.component_order(F.col("relative_path"))], "size", offset="bytes_before")
    return placed.select("relative_path", "position", "bytes_before")


@query(_sql(_ASSETS, select="SELECT relative_path, size FROM (SELECT *, row_number() OVER (ORDER BY string_split(relative_path, '/')) - 1 AS k FROM assets) WHERE k = 17"))
def e16_entry_at(spark, d):
    return listing.entry_at(_light(spark, d), 17).select("relative_path", "size")


# Windows, similarity, patterns

@query(_sql(_ASSETS, f"w AS (SELECT relative_path, hx, unnest(generate_series(0, least(size, 65536) - {WINDOW}, {STRIDE})) AS s FROM assets WHERE size >= {WINDOW})", select=f"SELECT relative_path, count(*) AS windows, count(DISTINCT md5(substr(hx, CAST(s * 2 + 1 AS BIGINT), {2 * WINDOW}))) AS distinct_windows FROM w GROUP BY 1"))
def f7_strided_windows(spark, d):
    w = windows.strided_windows(_assets(spark, d).select("relative_path", "content"), WINDOW, STRIDE, 65536)
    hashed = w.select("relative_path", F.xxhash64("window").alias("h"))
    return hashed.groupBy("relative_path", "h").count().groupBy("relative_path").agg(F.sum("count").alias("windows"), F.count("*").alias("distinct_windows"))


@query(_sql(_ASSETS, _BLOCKS, select="SELECT relative_path, ordinal, chunk_hash, length FROM blocks"))
def f8_tumbling_blocks(spark, d):
    return _blocks(spark, d).drop("window")


@query(_sql(_ASSETS, _BLOCKS, select="SELECT DISTINCT relative_path, chunk_hash AS signature FROM blocks"))
def e6_distinct_signatures(spark, d):
    return similarity.signatures(_assets(spark, d), BLOCK)


@query(_sql(_ASSETS, _BLOCKS, "sigs AS (SELECT DISTINCT relative_path, chunk_hash FROM blocks)", select="SELECT a.relative_path AS path_a, b.relative_path AS path_b, count(*) AS shared FROM sigs a JOIN sigs b ON a.chunk_hash = b.chunk_hash AND a.relative_path < b.relative_path GROUP BY 1, 2 HAVING count(*) >= 3"))
def d3_e5_similar_pairs(spark, d):
    return similarity.similar_pairs(_assets(spark, d), BLOCK, 3)


_PATTERN_SQL = (
    f"w AS (SELECT relative_path, substr(hx, CAST(s * 2 + 1 AS BIGINT), {2 * WINDOW}) AS body FROM (SELECT relative_path, hx, unnest(generate_series(0, least(size, 65536) - {WINDOW}, {STRIDE})) AS s FROM assets WHERE size >= {WINDOW}))",
    f"mined AS (SELECT md5(body) AS pattern_hash, body AS pattern_hex, CAST(sum(n) AS BIGINT) AS frequency, CAST(sum(n) * {WINDOW} - {WINDOW + 8} AS BIGINT) AS benefit FROM (SELECT relative_path, body, count(*) AS n FROM w GROUP BY 1, 2) GROUP BY body HAVING max(n) >= {LEAST})",
)


@query(_sql(_ASSETS, *_PATTERN_SQL, select="SELECT * FROM mined WHERE benefit > 0"))
def e7_pattern_mining(spark, d):
    return patterns.mine(_assets(spark, d), WINDOW, LEAST).select("pattern_hash", F.hex("pattern").alias("pattern_hex"), "frequency", "benefit")


@query(_sql(_ASSETS, *_PATTERN_SQL, select="SELECT CAST(row_number() OVER (ORDER BY benefit DESC, pattern_hash) - 1 AS INT) AS id, pattern_hash, frequency, benefit FROM mined WHERE benefit > 0 ORDER BY benefit DESC, pattern_hash LIMIT 50"))
def g3_top_patterns(spark, d):
    return patterns.top(patterns.mine(_assets(spark, d), WINDOW, LEAST), 50).select("id", "pattern_hash", "frequency", "benefit")


@query(_sql(_ASSETS, select="SELECT relative_path FROM (SELECT relative_path, row_number() OVER (ORDER BY string_split(relative_path, '/')) - 1 AS k, count(*) OVER () AS n FROM assets) WHERE k % greatest(1, n // 300) = 0 AND k < greatest(1, n // 300) * 300"))
def f10_stratified_sample(spark, d):
    return patterns.stratified_sample(_light(spark, d).select("relative_path"), [paths.component_order(F.col("relative_path"))], 300)


@query(_sql(_ASSETS, select="SELECT asset_type AS dict_class, CAST(k AS INT) AS rank, sample FROM (SELECT lower(asset_type) AS asset_type, row_number() OVER (PARTITION BY asset_type ORDER BY string_split(relative_path, '/')) AS k, md5(substr(hx, 1, 16384)) AS sample FROM (SELECT *, CASE WHEN asset_type = 'Unknown' THEN 'other' ELSE asset_type END AS t FROM assets) WHERE ext NOT IN ('png', 'ogg')) WHERE k <= 100").replace("lower(asset_type) AS asset_type", "lower(t) AS asset_type"))
def f11_dict_samples(spark, d):
    return codec.dict_samples(_assets(spark, d)).select("dict_class", "rank", F.md5(F.hex("sample")).alias("sample"))


@query()
def f9_content_chunks(spark, d):
    made = windows.content_chunks(_assets(spark, d), ["relative_path"], *CDC)
    return made.select("relative_path", "ordinal", "start", "length", F.md5("window").alias("chunk_md5"))


@query(_sql(_ASSETS, select="SELECT relative_path, size, hash_hex AS content_md5 FROM assets WHERE size > 0"))
def f9_chunks_cover(spark, d):
    """Content-defined chunks put together are the files."""
    made = windows.content_chunks(_assets(spark, d), ["relative_path"], *CDC)
    whole = made.groupBy("relative_path").agg(F.sum("length").alias("size"), F.array_sort(F.collect_list(F.struct("ordinal", F.hex("window").alias("piece")))).alias("p"))
    return whole.select("relative_path", "size", F.md5(F.unhex(F.array_join(F.col("p.piece"), ""))).alias("content_md5"))


@query()
def i8_apply_patterns(spark, d):
    a = _assets(spark, d)
    best = ordering.fixed(patterns.top(patterns.mine(a, WINDOW, LEAST)))
    parts = patterns.apply_patterns(a, best)
    back = patterns.resolve_segments(parts, best)
    refs = parts.groupBy("relative_path").agg(F.count("ref").alias("references"), F.count("literal").alias("literals"))
    return a.select("relative_path", F.hex("content").alias("h")).join(back, "relative_path").join(refs, "relative_path").select("relative_path", "references", "literals", (F.col("h") == F.col("content_hex")).alias("same"))


@query(_sql(_ASSETS, select="SELECT relative_path, true AS same FROM assets"))
def i8_round_trip(spark, d):
    return i8_apply_patterns(spark, d).select("relative_path", "same")


# Chunk store

@query(_sql(_ASSETS, _BLOCKS, _REFS, select="SELECT relative_path, ordinal, chunk_hash, length, stored FROM refs"))
def d10_f2_chunk_dedup(spark, d):
    return chunks.references(_blocks(spark, d).drop("window")).select("relative_path", "ordinal", "chunk_hash", "length", "stored")


@query(_sql(_ASSETS, _BLOCKS, _REFS, select="SELECT relative_path, ordinal, CAST(coalesce(sum(length) OVER (ORDER BY string_split(relative_path, '/'), ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS body_offset, length FROM refs WHERE stored"))
def f3_body_offsets(spark, d):
    stored = chunks.first_occurrences(_blocks(spark, d).drop("window")).select("relative_path", "ordinal", "length")
    return chunks.body_offsets(stored).select("relative_path", "ordinal", "body_offset", "length")


@query(_sql(_ASSETS, select="SELECT relative_path, size, md5(hx) AS content_md5 FROM assets WHERE size > 0"))
def f4_reassemble(spark, d):
    made = _blocks(spark, d)
    store = made.groupBy("chunk_hash").agg(F.first("window").alias("window"))
    return chunks.reassemble(made.drop("window"), store).select("relative_path", "size", F.md5("content_hex").alias("content_md5"))


@query(_sql(_ASSETS, _BLOCKS, select="SELECT relative_path, CAST(min(ordinal) AS INT) AS ordinal FROM (SELECT relative_path, ordinal, sum(length) OVER (PARTITION BY relative_path ORDER BY ordinal) AS running FROM blocks) WHERE running > 8192 GROUP BY 1"))
def f5_bomb_guard(spark, d):
    return chunks.bomb_guard(_blocks(spark, d).drop("window"), 8192)


@query(
    _sql(
        _ASSETS,
        _BLOCKS,
        "h AS (SELECT chunk_hash, count(*) AS refs, any_value(length) AS length FROM blocks GROUP BY 1)",
        select="""SELECT (SELECT count(DISTINCT relative_path) FROM blocks) AS asset_count, CAST((SELECT sum(length) FROM blocks) AS BIGINT) AS total_uncompressed_bytes,
        count(*) AS unique_chunk_count, CAST(sum(refs - 1) AS BIGINT) AS dedup_hits, CAST(sum((refs - 1) * length) AS BIGINT) AS dedup_bytes_saved, CAST(sum(length) AS BIGINT) AS stored_bytes FROM h""",
    )
)
def e8_package_manifest(spark, d):
    return chunks.manifest(_blocks(spark, d).drop("window"))


@query(_sql(_ASSETS, _BLOCKS, select="SELECT DISTINCT chunk_hash FROM blocks"))
def e13_distinct_hashes(spark, d):
    return chunks.distinct_hashes(_blocks(spark, d))


@query(_sql(_ASSETS, _CLUSTERS, _BLOCKS, _INDEX, select="SELECT relative_path, asset_type, size, duplicate_of, CAST(CASE WHEN held > 0 THEN ceil(size / 256.0) ELSE 0 END AS BIGINT) AS n_chunks, held > 0 AS chunk_based FROM idx"))
def d2_c18_index_build(spark, d):
    return _index(spark, d).select("relative_path", "asset_type", "size", "duplicate_of", F.size("chunks").cast("long").alias("n_chunks"), (F.size("chunks") > 0).alias("chunk_based"))


@query(_sql(_ASSETS, _CLUSTERS, _BLOCKS, _INDEX, select="SELECT * FROM listed"))
def e11_list_entries(spark, d):
    return listing.entries(_index(spark, d))


@query(_sql(_ASSETS, _CLUSTERS, _BLOCKS, _INDEX, select="SELECT count(*) AS files, CAST(sum(uncompressed_bytes) AS BIGINT) AS uncompressed_bytes, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes, CAST(sum(uncompressed_bytes) AS DOUBLE) / CAST(sum(compressed_bytes) AS DOUBLE) AS ratio FROM listed"))
def e10_list_totals(spark, d):
    return listing.totals(listing.entries(_index(spark, d)))


@query(_sql(_ASSETS, _CLUSTERS, _BLOCKS, _INDEX, select="SELECT path, uncompressed_bytes, is_duplicate FROM listed WHERE contains(lower(path), 'src1/') ORDER BY uncompressed_bytes DESC, string_split(path, '/')"))
def g1_c17_list_search_by_size(spark, d):
    return listing.by_size(listing.search(listing.entries(_index(spark, d)), "SRC1/")).select("path", "uncompressed_bytes", "is_duplicate")


@query(_sql(_ASSETS, select="SELECT size >= 16384 AS large, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM assets GROUP BY 1"))
def g4_large_and_small(spark, d):
    return _light(spark, d).groupBy((F.col("size") >= 16384).alias("large")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(_sql(_ASSETS, select="SELECT relative_path, doc_id % 9 <> 0 AS ok, CASE WHEN doc_id % 9 = 0 THEN CASE WHEN size <= 256 THEN 'missing chunk' ELSE 'missing chunk' END END AS reason FROM assets WHERE size > 0"))
def i5_i6_verify(spark, d):
    # the first chunk of every ninth file is taken away
    a = _light(spark, d).where("size > 0")
    index = a.select("relative_path", F.col("hash_hex").alias("content_hash"), "size", F.lit(None).cast("string").alias("duplicate_of"))
    made = _blocks(spark, d).withColumn("chunk_hash", F.concat("relative_path", F.lit("#"), "ordinal"))
    lost = (F.col("ordinal") == 0) & (F.regexp_extract("relative_path", r"doc_(\d+)", 1).cast("long") % 9 == 0)
    return integrity.verify(index, chunks.reassemble(made.drop("window"), made.where(~lost)))


@query(_sql(_ASSETS, select="SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 9 <> 0) AS verified, count(*) FILTER (WHERE doc_id % 9 = 0) AS failed FROM assets WHERE size > 0"))
def e9_verify_summary(spark, d):
    return integrity.verify_summary(i5_i6_verify(spark, d))


@query(_sql(_ASSETS, "made AS (SELECT relative_path, size, hx || CASE WHEN doc_id % 3 = 0 THEN '4E50534947310000' || repeat('AB', 96) ELSE '' END AS h, doc_id % 3 = 0 AS signed, hash_hex FROM assets)", select="SELECT relative_path, signed AS is_signed, size AS unsigned_length, sha256(unhex(substr(h, 1, CAST(size * 2 AS BIGINT)))) AS prefix_sha256 FROM made"))
def i9_i13_i14_signature_block(spark, d):
    a = _assets(spark, d).withColumn("n", F.regexp_extract("relative_path", r"doc_(\d+)", 1).cast("long"))
    block = F.unhex(F.lit(integrity.BLOCK_MAGIC + "AB" * 96))
    a = a.withColumn("content", F.when(F.col("n") % 3 == 0, F.concat("content", block)).otherwise(F.col("content")))
    c = F.col("content")
    return a.select("relative_path", integrity.is_signed(c).alias("is_signed"), integrity.unsigned_length(c).alias("unsigned_length"), integrity.prefix_sha256(c, integrity.unsigned_length(c)).alias("prefix_sha256"))


# Versions

_V = (_VERSIONS, _versions_as("old_docs", "old_assets"), _versions_as("new_docs", "new_assets"))
_VB = (*_V, _blocks_of("old_assets", "old_blocks"), _blocks_of("new_assets", "new_blocks"))


@query(_sql(*_V, _DIFF, select="SELECT * FROM diff"))
def d4_patch_diff(spark, d):
    old, new = _old_new(spark, d)
    return versions.diff(old.drop("content"), new.drop("content"))


@query(_sql(*_V, _DIFF, select="SELECT * FROM diff WHERE kind <> 'Unchanged'"))
def h1_patch_entries(spark, d):
    old, new = _old_new(spark, d)
    return versions.changes(old.drop("content"), new.drop("content"))


@query(_sql(*_V, select="SELECT relative_path FROM old_assets EXCEPT SELECT relative_path FROM new_assets"))
def h2_removed(spark, d):
    return versions.removed(*_old_new(spark, d))


@query(_sql(*_VB, select="SELECT chunk_hash FROM old_blocks INTERSECT SELECT chunk_hash FROM new_blocks"))
def h3_common_hashes(spark, d):
    return versions.common_hashes(*(chunks.fixed_chunks(v, BLOCK) for v in _old_new(spark, d)))


@query(_sql(*_VB, select="SELECT chunk_hash FROM old_blocks UNION SELECT chunk_hash FROM new_blocks"))
def h4_all_hashes(spark, d):
    return versions.all_hashes(*(chunks.fixed_chunks(v, BLOCK) for v in _old_new(spark, d)))


@query(_sql(*_VB, select="SELECT chunk_hash, any_value(length) AS length FROM new_blocks WHERE chunk_hash NOT IN (SELECT chunk_hash FROM old_blocks) GROUP BY 1"))
def d5_patch_new_chunks(spark, d):
    return versions.new_chunks(*(chunks.fixed_chunks(v, BLOCK) for v in _old_new(spark, d))).select("chunk_hash", "length")


@query(
    _sql(
        *_VB,
        _DIFF,
        "near AS (SELECT relative_path, chunk_hash, min(ordinal) AS o FROM old_blocks GROUP BY 1, 2)",
        "far AS (SELECT chunk_hash, min(struct_pack(p := relative_path, o := ordinal)) AS f FROM old_blocks GROUP BY 1)",
        select="""SELECT n.relative_path, n.ordinal, n.chunk_hash, n.length, CASE WHEN near.o IS NOT NULL THEN n.relative_path ELSE far.f.p END AS source_path, CAST(coalesce(near.o, far.f.o) AS INT) AS source_ordinal
        FROM new_blocks n JOIN diff ON n.relative_path = diff.relative_path AND diff.kind IN ('Added', 'Modified')
        LEFT JOIN near ON n.relative_path = near.relative_path AND n.chunk_hash = near.chunk_hash LEFT JOIN far ON n.chunk_hash = far.chunk_hash""",
    )
)
def d6_patch_references(spark, d):
    old, new = _old_new(spark, d)
    changed = versions.changes(old.drop("content"), new.drop("content"))
    return versions.patch_references(chunks.fixed_chunks(old, BLOCK), chunks.fixed_chunks(new, BLOCK), changed)


_PLAN = "plan AS (SELECT n.relative_path, n.size, CASE WHEN o.size = n.size AND o.hash_hex = n.hash_hex THEN 'reuse' ELSE 'recompress' END AS action FROM new_assets n LEFT JOIN old_assets o ON n.relative_path = o.relative_path)"


@query(_sql(*_V, _PLAN, select="SELECT * FROM plan"))
def d7_c19_incremental_plan(spark, d):
    old, new = _old_new(spark, d)
    return versions.incremental_plan(new.drop("content"), old.drop("content"))


@query(
    _sql(
        *_V,
        _PLAN,
        select="""SELECT count(*) AS total, count(*) FILTER (WHERE action = 'reuse') AS reused, count(*) FILTER (WHERE action = 'recompress') AS recompressed,
        (SELECT count(*) FROM old_assets WHERE relative_path NOT IN (SELECT relative_path FROM new_assets)) AS deleted, greatest((SELECT count(*) FROM old_assets) - count(*), 0) AS deleted_by_difference FROM plan""",
    )
)
def e12_incremental_stats(spark, d):
    old, new = _old_new(spark, d)
    return versions.incremental_stats(versions.incremental_plan(new.drop("content"), old.drop("content")), old)


@query(_sql(*_VB, _PLAN, select="SELECT relative_path, ordinal, chunk_hash FROM old_blocks WHERE relative_path IN (SELECT relative_path FROM plan WHERE action = 'reuse')"))
def b9_reuse_rows(spark, d):
    old, new = _old_new(spark, d)
    plan = versions.incremental_plan(new.drop("content"), old.drop("content"))
    return versions.reuse_rows(chunks.fixed_chunks(old, BLOCK).drop("window"), plan).select("relative_path", "ordinal", "chunk_hash")


@query(_sql(*_V, select="SELECT relative_path, hash_hex AS content_md5, true AS ok FROM new_assets"))
def j4_patch_round_trip(spark, d):
    old, new = _old_new(spark, d)
    built = patch.apply_patch(old, patch.build_patch(old, new, CDC), CDC)
    return built.select("relative_path", F.md5("content").alias("content_md5"), "ok")


@query(_sql(*_V, select="SELECT relative_path, hash_hex AS content_md5, true AS ok FROM new_assets"))
def b7_patch_on_disk(spark, d):
    old, new = _old_new(spark, d)
    path = ordering.scratch(spark)
    patch.write_patch(spark, patch.build_patch(old, new, CDC), path, CDC)
    built = patch.apply_patch(old, *patch.open_patch(spark, path))
    return built.select("relative_path", F.md5("content").alias("content_md5"), "ok")


@query(
    _sql(
        *_V,
        select="""SELECT relative_path, 1 AS version, 0 AS mtime_nanos, size AS file_size, hash_hex AS content_hash, asset_type AS entry_type FROM (
        SELECT relative_path, size, hash_hex, asset_type FROM new_assets
        UNION ALL SELECT relative_path, size, hash_hex, asset_type FROM old_assets WHERE relative_path NOT IN (SELECT relative_path FROM new_assets))""",
    )
)
def c21b_manifest_rows(spark, d):
    """What the older build remembers, with the newer build's rows inserted."""
    rows = [versions.manifest_rows(a, a.select("relative_path", "asset_type"), 1) for a in (x.drop("content") for x in _old_new(spark, d))]
    return versions.manifest_insert(*rows).select("relative_path", "version", "mtime_nanos", "file_size", "content_hash", F.col("index_entry.asset_type").alias("entry_type"))


# Codecs and verbs

@query(_sql(_ASSETS, select="SELECT relative_path, true AS same FROM assets WHERE ext NOT IN ('png', 'ogg')"))
def i1_i2_i3_zstd_round_trip(spark, d):
    a = _assets(spark, d)
    dicts = codec.train_dicts(codec.dict_samples(a))
    packed = a.where(~classify.stored_raw(F.col("asset_type"), F.col("relative_path"))).select("relative_path", "content", classify.codec_level(F.col("asset_type")).alias("level"), classify.dict_class(F.col("asset_type")).alias("dict_class"))
    packed = packed.withColumn("data", codec.compress("content", "level", "dict_class", dicts))
    return packed.select("relative_path", (codec.decompress("data", "dict_class", dicts) == F.col("content")).alias("same"))


def _package(spark, d) -> str:
    path = ordering.scratch(spark)
    package.build(_assets(spark, d), path, cdc=CDC)
    return path


@query(_sql(_ASSETS, select="SELECT relative_path, hash_hex AS content_md5, true AS ok FROM assets"))
def j2_b1_b2_package_round_trip(spark, d):
    out = package.extract_all(package.open_package(spark, _package(spark, d)))
    return out.select("relative_path", F.md5("content").alias("content_md5"), F.col("reason").isNull().alias("ok"))


@query(_sql(_ASSETS, _CLUSTERS, select="SELECT relative_path, true AS ok FROM assets WHERE relative_path NOT IN (SELECT relative_path FROM dups)"))
def j7_verify_package(spark, d):
    return package.verify(package.open_package(spark, _package(spark, d))).select("relative_path", "ok")


@query(_sql(_ASSETS, select="SELECT relative_path, md5(text) AS content_md5 FROM assets WHERE relative_path = 'en/src1/doc_21.obj'"))
def b3_b4_b5_d9_extract_file(spark, d):
    tables = package.open_package(spark, _package(spark, d))
    path = "en/src1/doc_21.obj"
    try:
        found = package.extract_file(tables, path)
    except KeyError:  # no file of that name: no row
        return spark.createDataFrame([], "relative_path string, content_md5 string")
    return found.select(F.lit(path).alias("relative_path"), F.md5("content").alias("content_md5"))


@query(_sql(*(_VERSIONS, _versions_as("old_docs", "old_assets"), _versions_as("new_docs", "new_assets")), select="SELECT relative_path, hash_hex AS content_md5, true AS ok FROM new_assets"))
def j3_b8_incremental_build(spark, d):
    old, new = _old_new(spark, d)
    first, second = ordering.scratch(spark), ordering.scratch(spark)
    package.build(old, first, cdc=CDC)
    package.build_incremental(new, first, second, cdc=CDC)
    out = package.extract_all(package.open_package(spark, second))
    return out.select("relative_path", F.md5("content").alias("content_md5"), F.col("reason").isNull().alias("ok"))


@query(_sql(*(_VERSIONS, _versions_as("old_docs", "old_assets"), _versions_as("new_docs", "new_assets")), select="SELECT count(*) AS asset_count, CAST(sum(size) AS BIGINT) AS total_uncompressed_bytes, true AS chunks_counted, true AS dicts_named FROM new_assets"))
def e8b_incremental_manifest(spark, d):
    """The manifest of an incremental package against its own tables."""
    old, new = _old_new(spark, d)
    first, second = ordering.scratch(spark), ordering.scratch(spark)
    package.build(old, first, cdc=CDC)
    package.build_incremental(new, first, second, cdc=CDC)
    tables = package.open_package(spark, second)
    counted = tables["manifest"].crossJoin(tables["chunks"].agg(F.count("*").alias("n"))).crossJoin(tables["refs"].agg(F.count("*").alias("r")))  # one row each
    stray = tables["dicts"].join(tables["chunks"], ["dict_id", "dict_class"], "left_anti").agg(F.count("*").alias("stray"))
    chunks_counted = (F.col("unique_chunk_count") == F.col("n")) & (F.col("dedup_hits") == F.col("r") - F.col("n"))
    return counted.crossJoin(stray).select("asset_count", "total_uncompressed_bytes", chunks_counted.alias("chunks_counted"), (F.col("stray") == 0).alias("dicts_named"))


@query(_sql(_ASSETS, select="SELECT relative_path, size, hash_hex FROM assets"))
def a1_folder_scan(spark, d):
    """Every document as a file of a folder, which is then scanned."""
    root = f"{ordering.scratch(spark)}".removeprefix("file://").removeprefix("file:")
    package.write_files(_assets(spark, d).select("relative_path", "content", F.lit(None).cast("string").alias("reason")), root).collect()
    return sources.scan_assets(spark, root).select("relative_path", "size", "hash_hex")


@query("SELECT true AS signed, true AS wrong_key_refused, true AS change_found")
def i10_i11_i12_signatures(spark, d):
    """Sign a package, check it with another key, change it and check again."""
    path, keys = _package(spark, d), integrity.Ed25519(spark)
    private, public = keys.generate()
    package.sign(spark, path, private, public)
    signed = package.verify_signature(spark, path) == public

    def refused(expected: bytes | None) -> bool:
        try:
            package.verify_signature(spark, path, expected)
        except ValueError:
            return True
        return False

    other = refused(keys.generate()[1])
    package.open_package(spark, path)["refs"].limit(1).write.mode("append").parquet(f"{path}/refs")
    return spark.createDataFrame([(signed, other, refused(None))], "signed boolean, wrong_key_refused boolean, change_found boolean")


@query()
def e14_codec_benchmark(spark, d):
    return codec.benchmark(_assets(spark, d))


@query()
def j6_benchmark(spark, d):
    """A row a codec and a row a package, the package without a type's own settings and with them."""
    return benchmark.run(_assets(spark, d), cdc=CDC)


@query(_sql(_ASSETS, select="SELECT relative_path, hash_hex AS content_md5, true AS ok FROM assets"))
def b4c_extract_to_folder(spark, d):
    """Entries written to a folder chunk by chunk, which is then scanned."""
    root = ordering.scratch(spark).removeprefix("file://").removeprefix("file:")
    wrote = ordering.fixed(package.extract_to(package.open_package(spark, _package(spark, d)), root))  # files are written once
    found = sources.scan_assets(spark, root).select("relative_path", F.col("hash_hex").alias("content_md5"))
    return wrote.join(found, "relative_path", "left").select("relative_path", "content_md5", "ok")


@query(
    _sql(
        _ASSETS,
        _CLUSTERS,
        "types AS (SELECT t.asset_type, count(a.size) AS files, CAST(coalesce(sum(a.size), 0) AS BIGINT) AS bytes FROM (VALUES ('Texture'), ('Mesh'), ('Audio'), ('Unknown')) t(asset_type) LEFT JOIN assets a USING (asset_type) GROUP BY 1)",
        select="""SELECT types.*, CAST((SELECT sum(files) FROM types) AS BIGINT) AS total_files, CAST((SELECT sum(bytes) FROM types) AS BIGINT) AS total_bytes, (SELECT count(*) FROM clusters) AS clusters,
        CAST(coalesce((SELECT sum(n_paths - 1) FROM clusters), 0) AS BIGINT) AS duplicate_files, CAST(coalesce((SELECT sum(size * (n_paths - 1)) FROM clusters), 0) AS BIGINT) AS wasted_bytes,
        CAST(bytes AS DOUBLE) / CAST((SELECT sum(bytes) FROM types) AS DOUBLE) * 100 AS percent FROM types""",
    )
)
def j1_analyze(spark, d):
    return analyze_plan.analyze(_light(spark, d))


@query(
    _sql(
        _ASSETS,
        _CLUSTERS,
        _BLOCKS,
        "sigs AS (SELECT DISTINCT relative_path, chunk_hash FROM blocks)",
        select="""SELECT 'duplicate' AS kind, a.relative_path AS path, d.duplicate_of AS other, a.size AS amount FROM dups d JOIN assets a USING (relative_path)
        UNION ALL SELECT 'similar', a.relative_path, b.relative_path, count(*) FROM sigs a JOIN sigs b ON a.chunk_hash = b.chunk_hash AND a.relative_path < b.relative_path GROUP BY 2, 3 HAVING count(*) >= 3""",
    )
)
def j1_findings(spark, d):
    return analyze_plan.findings(_assets(spark, d), BLOCK)
