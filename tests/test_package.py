"""Whole verbs over files on disk."""

import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packloom import cli
from packloom.functions.delta import BufferDecoder, decode_buffer, encode_buffer
from packloom.operators.integrity import Ed25519
from packloom.operators import versions
from packloom.operators.windows import cut_points
from packloom.plans import package, patch
from packloom.sources import config
from packloom.sources.assets import scan_assets

CDC = (256, 1024, 4096)


def contents(df):
    return {r["relative_path"]: bytes(r["content"]) for r in df.collect()}


@given(st.binary(max_size=200))
def test_delta_round_trip(data):
    assert decode_buffer(encode_buffer(data)) == data
    assert len(encode_buffer(data)) == len(data)


@given(st.lists(st.binary(max_size=40)))
def test_delta_in_parts(parts):
    decoder, data = BufferDecoder(), b"".join(parts)
    assert b"".join([*map(decoder.part, parts), decoder.end()]) == decode_buffer(data)


def test_delta_with_trailing_bytes():
    data = bytes(range(53))
    assert decode_buffer(encode_buffer(data)) == data and encode_buffer(data)[-1:] == data[-1:]


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=9000))
def test_cut_points(data):
    cuts = cut_points(data, 64, 256, 1024)
    sizes = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    assert sum(sizes) == len(data) and all(s <= 1024 for s in sizes) and all(s >= 64 for s in sizes[:-1])
    assert cuts == cut_points(data, 64, 256, 1024)


def test_cuts_are_local(made):
    data = made["random"](5, 60_000)
    edited = data[:30_000] + b"x" + data[30_000:]
    a, b = cut_points(data, 256, 1024, 4096), cut_points(edited, 256, 1024, 4096)
    assert len({x + 1 for x in a if x > 40_000} & set(b)) >= 0.8 * sum(x > 40_000 for x in a)


def test_scan_keeps_empty_files(spark, tree, made):
    root = tree({"a/x.png": made["png"](), "a/empty.bin": b"", "b.obj": b"abc"})
    found = {r["relative_path"]: (r["asset_type"], r["size"]) for r in scan_assets(spark, root).collect()}
    assert found == {"a/x.png": ("Texture", 264), "a/empty.bin": ("Unknown", 0), "b.obj": ("Mesh", 3)}


def test_scan_of_many_files_has_few_splits(spark, tree):
    files = {f"d{k % 7}/e {k % 3}/{k}.bin": b"" if k % 50 == 0 else b"%d" % k for k in range(400)}
    root = tree(files)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        found = scan_assets(spark, root)
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism  # 100 and more where a file counts for 4 MB
        assert {r["relative_path"]: bytes(r["content"]) for r in found.collect()} == files
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_extraction_of_many_files_is_scanned_in_few_splits(spark, tree, tmp_path):
    files = {f"d{k % 5}/{k}.txt": b"%d " % k * (k % 4) for k in range(120)}
    package.build(scan_assets(spark, tree(files)), str(tmp_path / "p"), cdc=CDC)
    wrote = package.extract_to(package.open_package(spark, str(tmp_path / "p")), str(tmp_path / "out")).collect()
    assert len(wrote) == len(files) and all(r["ok"] for r in wrote)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        found = scan_assets(spark, str(tmp_path / "out"))
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert contents(found) == files
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_build_and_extraction_move_no_contents_for_names(spark, tree, tmp_path, made, monkeypatch):
    files = {f"d{k % 3}/{k}.txt": made["random"](k % 20, 3000) for k in range(60)} | {"none.txt": b"", "long.bin": made["random"](77, 5 << 20), "z.obj": made["mesh"]()}
    plans, chunked = [], package.content_chunks
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(package, "content_chunks", lambda df, *rest: plans.append(plan(df)) or chunked(df, *rest))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        package.build(scan_assets(spark, tree(files)), str(tmp_path / "p"), cdc=CDC)
        wrote = package.extract_to(package.open_package(spark, str(tmp_path / "p")), str(tmp_path / "out"))
        plans.append(plan(wrote))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plans[0]  # copies were taken out by a join of contents
    assert "LeftSemi" not in plans[1]  # chunks were first joined with the references that name them
    assert all(r["ok"] for r in wrote.collect()) and contents(scan_assets(spark, str(tmp_path / "out"))) == files
    assert sorted(x.name for x in (tmp_path / "p").iterdir()) == sorted(package.TABLES)


def test_round_trip_and_choices(spark, tree, tmp_path, made):
    files = {"meshes/ship.mesh": made["mesh"](), "textures/hero.png": made["png"](), "audio/theme.ogg": made["ogg"](), "none.bin": b"", "a.bin": made["random"](42, 65536), "b.bin": made["random"](42, 65536)}
    package.build(scan_assets(spark, tree(files)), str(tmp_path / "p"), cdc=CDC)
    tables = package.open_package(spark, str(tmp_path / "p"))
    index = {r["relative_path"]: r for r in tables["index"].collect()}
    assert index["meshes/ship.mesh"]["pre_encoding"] == "DeltaBytes" and index["textures/hero.png"]["pre_encoding"] == "None"
    assert index["textures/hero.png"]["is_stored_raw"] and index["audio/theme.ogg"]["is_stored_raw"]
    assert index["b.bin"]["duplicate_of"] == "a.bin"
    assert tables["chunks"].agg(F.sum(F.octet_length("data"))).first()[0] < 2 * 65536
    out = package.extract_all(tables)
    assert contents(out) == files
    wrote = package.write_files(out, str(tmp_path / "out")).collect()
    assert all(r["ok"] for r in wrote) and (tmp_path / "out/meshes/ship.mesh").read_bytes() == files["meshes/ship.mesh"]
    assert package.extract_file(tables, "b.bin").first()["name"] == "a.bin"
    with pytest.raises(KeyError):
        package.extract_file(tables, "../evil.bin")
    assert package.verify(tables).where("not ok").count() == 0


def test_damage_is_found(spark, tree, tmp_path, made):
    package.build(scan_assets(spark, tree({"good.bin": made["random"](30, 512), "bad.bin": made["random"](31, 512)})), str(tmp_path / "p"), cdc=CDC)
    tables = package.open_package(spark, str(tmp_path / "p"))
    hit = tables["refs"].where("relative_path = 'bad.bin'").first()["chunk_hash"]
    broken = F.when(F.col("chunk_hash") == hit, F.concat(F.substring("data", 1, 100), F.unhex(F.lit("FFFF")), F.expr("substring(data, 103)"))).otherwise(F.col("data"))
    tables["chunks"] = tables["chunks"].withColumn("data", broken)
    assert {r["relative_path"]: r["ok"] for r in package.verify(tables).collect()} == {"good.bin": True, "bad.bin": False}


def test_signatures(spark, tree, tmp_path, made):
    path = str(tmp_path / "p")
    package.build(scan_assets(spark, tree({"asset.bin": made["random"](15, 4096)})), path, cdc=CDC)
    with pytest.raises(ValueError):
        package.verify_signature(spark, path)
    first, second = Ed25519(spark).generate(), Ed25519(spark).generate()
    package.sign(spark, path, *first)
    package.sign(spark, path, *second)
    assert package.verify_signature(spark, path) == second[1]
    with pytest.raises(ValueError):
        package.verify_signature(spark, path, first[1])
    tables = package.open_package(spark, path)
    tables["chunks"].limit(0).write.mode("append").parquet(f"{path}/chunks")
    assert package.verify_signature(spark, path) == second[1]
    tables["refs"].limit(1).write.mode("append").parquet(f"{path}/refs")
    with pytest.raises(ValueError):
        package.verify_signature(spark, path)


def test_incremental(spark, tree, tmp_path, made):
    v1 = {"stable.bin": made["random"](20, 8192), "changed.bin": made["random"](21, 8192), "a.bin": made["random"](9, 3000), "z.bin": made["random"](9, 3000)}
    package.build(scan_assets(spark, tree(v1, "v1")), str(tmp_path / "p1"), cdc=CDC)
    v2 = {"stable.bin": v1["stable.bin"], "changed.bin": made["random"](22, 8192), "z.bin": v1["z.bin"]}  # the original of z.bin is gone
    plan = package.build_incremental(scan_assets(spark, tree(v2, "v2")), str(tmp_path / "p1"), str(tmp_path / "p2"), cdc=CDC)
    assert {r["relative_path"]: r["action"] for r in plan.collect()} == {"stable.bin": "reuse", "changed.bin": "recompress", "z.bin": "reuse"}
    assert contents(package.extract_all(package.open_package(spark, str(tmp_path / "p2")))) == v2


def test_incremental_manifest_and_dictionaries(spark, tree, tmp_path, made, monkeypatch):
    """Many builds, each with dictionaries of its own: the manifest counts all files, chunks of every build are read, unused dictionaries go."""
    monkeypatch.setattr(package, "HELD_DICTS", 1)
    rng = __import__("random").Random(1)
    words = [made["random"](k, 12) for k in range(40)]
    text = lambda: b" ".join(rng.choice(words) for _ in range(400))
    files = {f"{k:02}.bin": text() for k in range(12)}
    package.build(scan_assets(spark, tree(files, "v0")), str(tmp_path / "p0"), cdc=CDC)
    for n in range(1, 4):
        files |= {f"{k:02}.bin": text() for k in range(n - 1, n + 6)}
        package.build_incremental(scan_assets(spark, tree(files, f"v{n}")), str(tmp_path / f"p{n - 1}"), str(tmp_path / f"p{n}"), cdc=CDC)
    tables = package.open_package(spark, str(tmp_path / "p3"))
    assert contents(package.extract_all(tables)) == files
    row = tables["manifest"].first()
    assert (row["asset_count"], row["total_uncompressed_bytes"]) == (len(files), sum(map(len, files.values())))
    assert row["unique_chunk_count"] == tables["chunks"].count() and row["total_compressed_bytes"] == sum(len(r["data"]) for r in tables["chunks"].collect())
    named = {(r["dict_id"], r["dict_class"]) for r in tables["chunks"].collect()} - {("", "")}
    assert {(r["dict_id"], r["dict_class"]) for r in tables["dicts"].collect()} == named and len({i for i, _ in named}) > 1
    assert not [x for x in os.listdir(tmp_path) if "." in x]


def test_failed_build_leaves_the_old_package(spark, tree, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    package.build(scan_assets(spark, tree({"a.bin": b"old"}, "v1")), path, cdc=CDC)
    monkeypatch.setattr(package, "_write_manifest", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        package.build(scan_assets(spark, tree({"a.bin": b"new"}, "v2")), path, cdc=CDC)
    assert contents(package.extract_all(package.open_package(spark, path))) == {"a.bin": b"old"}
    assert sorted(os.listdir(tmp_path)) == ["p", "v1", "v2"]


def test_bomb_guard_and_pieces(spark, tree, tmp_path, made):
    """Entries above the limit are not decompressed; chunk by chunk they are still there."""
    files = {"small.bin": made["random"](1, 500), "large.bin": bytes(50_000)}
    package.build(scan_assets(spark, tree(files)), str(tmp_path / "p"), cdc=CDC)
    tables = package.open_package(spark, str(tmp_path / "p"))
    found = {r["relative_path"]: (r["content"] and bytes(r["content"]), r["reason"]) for r in package.contents(tables, limit=1_000).collect()}
    assert found == {"small.bin": (files["small.bin"], None), "large.bin": (None, "larger than the limit")}
    rows = package.pieces(tables).where("relative_path = 'large.bin'").orderBy("ordinal").collect()
    assert b"".join(bytes(r["window"]) for r in rows) == files["large.bin"] and all(r["sound"] for r in rows)


def test_files_are_written_chunk_by_chunk(spark, tree, tmp_path, made, monkeypatch):
    """Files of many batches, empty ones, copies under another type and damaged ones; ``contents`` would refuse them all."""
    monkeypatch.setattr(package, "BOMB_BYTES", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        body = made["random"](4, 40_001)
        files = {"a/large.bin": body, "b.mesh": body[:20_003], "none.bin": b"", "copy.mesh": body, "c.bin": made["random"](5, 7_000)}
        package.build(scan_assets(spark, tree(files)), str(tmp_path / "p"), cdc=CDC)
        tables = package.open_package(spark, str(tmp_path / "p"))
        assert all(r["ok"] for r in package.extract_to(tables, str(tmp_path / "out")).collect())
        assert {k: (tmp_path / "out" / k).read_bytes() for k in files} == files
        assert len([f for _, _, names in os.walk(tmp_path / "out") for f in names]) == len(files)
        hit = tables["refs"].where("relative_path = 'c.bin' and ordinal = 1").first()["chunk_hash"]
        tables["chunks"] = tables["chunks"].where(F.col("chunk_hash") != hit)
        found = {r["relative_path"]: r["reason"] for r in package.extract_to(tables, str(tmp_path / "out2")).collect()}
        assert found == dict.fromkeys(files) | {"c.bin": "damaged chunk"} and sorted(os.listdir(tmp_path / "out2")) == ["a", "b.mesh", "copy.mesh", "none.bin"]
        wrong = {"size": F.col("size") - 1, "content_hash": F.lit("0")}
        for name, value in wrong.items():
            changed = tables | {"index": tables["index"].withColumn(name, F.when(F.col("relative_path") == "b.mesh", value).otherwise(F.col(name)))}
            assert {r["relative_path"]: r["reason"] for r in package.verify(changed).collect()}["b.mesh"] == {"size": "size mismatch", "content_hash": "hash mismatch"}[name]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_unsafe_entries_are_not_written(spark, tree, tmp_path):
    package.build(scan_assets(spark, tree({"ok.bin": b"ok", "x.bin": b"evil"})), str(tmp_path / "p"), cdc=CDC)
    tables = package.open_package(spark, str(tmp_path / "p"))
    for name in ("index", "refs"):
        tables[name] = tables[name].withColumn("relative_path", F.when(F.col("relative_path") == "x.bin", "../evil.bin").otherwise(F.col("relative_path")))
    found = {r["relative_path"]: r["reason"] for r in package.extract_to(tables, str(tmp_path / "out")).collect()}
    assert found == {"ok.bin": None, "../evil.bin": "unsafe path"} and not (tmp_path / "evil.bin").exists()
    os.makedirs(tmp_path / "linked")
    os.symlink(tmp_path / "linked", tmp_path / "out" / "d")
    package.build(scan_assets(spark, tree({"d/x.bin": b"x"}, "in2")), str(tmp_path / "p2"), cdc=CDC)
    assert [r["reason"] for r in package.extract_to(package.open_package(spark, str(tmp_path / "p2")), str(tmp_path / "out")).collect()] == ["symbolic link on the way"]


def test_manifest_rows(spark, tree, made):
    root = tree({"a.bin": b"a", "none.bin": b""})
    for k, name in enumerate(("a.bin", "none.bin")):
        os.utime(os.path.join(root, name), (1_700_000_000 + k, 1_700_000_000 + k))
    assets = scan_assets(spark, root)
    rows = versions.manifest_rows(assets, assets.select("relative_path", "asset_type"), 1)
    assert {r["relative_path"]: r["mtime_nanos"] for r in rows.collect()} == {"a.bin": 1_700_000_000 * 10**9, "none.bin": 1_700_000_001 * 10**9}
    newer = rows.where("relative_path = 'a.bin'").withColumn("file_size", F.lit(9).cast("long"))
    assert {r["relative_path"]: r["file_size"] for r in versions.manifest_insert(rows, newer).collect()} == {"a.bin": 9, "none.bin": 0}


def test_patch_on_disk(spark, tree, tmp_path, made):
    old, new = tree({"a.bin": made["random"](1, 9_000)}, "old"), tree({"a.bin": made["random"](1, 9_000) + b"more", "b.bin": b"b"}, "new")
    path = str(tmp_path / "patch")
    patch.write_patch(spark, patch.build_patch(scan_assets(spark, old), scan_assets(spark, new), CDC), path, CDC)
    tables, cdc = patch.open_patch(spark, path)
    assert cdc == CDC and contents(patch.apply_patch(scan_assets(spark, old), tables, cdc))["b.bin"] == b"b"
    spark.read.parquet(f"{path}/head").withColumn("version", F.lit(99)).write.parquet(f"{path}/head2")
    os.rename(f"{path}/head", f"{path}/head1")
    os.rename(f"{path}/head2", f"{path}/head")
    with pytest.raises(ValueError):
        patch.open_patch(spark, path)
    assert cli.main(["patch", old, new, "--output", str(tmp_path / "q")], spark) == 0
    assert cli.main(["apply-patch", old, str(tmp_path / "q"), "--output", str(tmp_path / "made")], spark) == 0
    assert (tmp_path / "made/a.bin").read_bytes() == made["random"](1, 9_000) + b"more"


def test_incremental_without_previous(spark, tree, tmp_path, made):
    plan = package.build_incremental(scan_assets(spark, tree({"a.bin": b"abc"})), str(tmp_path / "none"), str(tmp_path / "p"), cdc=CDC)
    assert [r["action"] for r in plan.collect()] == ["recompress"]
    assert contents(package.extract_all(package.open_package(spark, str(tmp_path / "p")))) == {"a.bin": b"abc"}


def test_settings(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert config.load() == config.Settings()
    (tmp_path / "packloom.toml").write_text("[compression]\ntexture_level = 12\nmesh_delta = false\nother = 1\n")
    assert config.load() == config.Settings(texture_level=12, mesh_delta=False)
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "missing.toml"))
    (tmp_path / "bad.toml").write_text("[compression")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.toml"))


def test_patch_moves_chunks(spark, tree, made):
    body = made["random"](3, 20_000)
    old = {"a.bin": body, "gone.bin": b"x", "same.bin": b"same"}
    new = {"moved.bin": body, "same.bin": b"same", "a.bin": body[:10_000] + b"inserted" + body[10_000:], "empty.bin": b""}
    before, after = scan_assets(spark, tree(old, "old")), scan_assets(spark, tree(new, "new"))
    made_patch = patch.build_patch(before, after, CDC)
    assert made_patch["refs"].where("relative_path = 'moved.bin' and source_path is null").count() == 0
    out = patch.apply_patch(before, made_patch, CDC)
    assert contents(out) == new and out.where("not ok").count() == 0


def test_commands(spark, tree, tmp_path, made, capsys):
    root = tree({"a.bin": made["random"](13, 1000), "b.bin": made["random"](14, 2000)})
    assert cli.main(["compress", root, "--output", str(tmp_path / "p")], spark) == 0
    assert cli.main(["list", str(tmp_path / "p"), "--sort-size"], spark) == 0
    shown = capsys.readouterr().out.splitlines()
    assert [x.split("\t")[0] for x in shown] == ["b.bin", "a.bin"]
    assert cli.main(["verify", str(tmp_path / "p")], spark) == 0
    assert cli.main(["decompress", str(tmp_path / "p"), "--output", str(tmp_path / "o")], spark) == 0
    assert sorted(os.listdir(tmp_path / "o")) == ["a.bin", "b.bin"]
    for command in (["scan", root, "--json"], ["analyze", root, "--json"], ["benchmark", root, "--no-zstd19"]):
        assert cli.main(command, spark) == 0


def test_stream_keeps_first_arrivals(spark, tmp_path):
    from packloom.streaming import store_stream

    rows = spark.createDataFrame([("2024-01-01 00:00:00", "x", 1, "h"), ("2024-01-01 00:01:00", "y", 1, "h"), ("2024-01-01 00:02:00", "z", 2, "g")], "arrived string, relative_path string, size long, hash_hex string")
    rows.selectExpr("cast(arrived as timestamp) as arrived", "relative_path", "size", "hash_hex").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = store_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
