"""The binary container: a file written here by hand is listed, decoded and checked."""

import pytest
import xxhash
import zstandard

from packloom.functions.delta import encode_buffer
from packloom.operators import listing
from packloom.sources import container as c


def entry(path, data, **more):
    return {"relative_path": path, "asset_type": 3, "content_hash": xxhash.xxh3_64_intdigest(data), "compressed_offset": 0, "compressed_length": 0, "uncompressed_length": len(data), "duplicate_of": None, "pre_encoding": 0, "chunks": [], "is_stored_raw": False} | more


def save(path, version, entries, body, patterns=(), dicts=()):
    schema = c.DICTIONARY if version >= 3 else c.DICTIONARY_V1
    words = c.write(schema, {"patterns": [{"id": i, "hash": 0, "bytes": p, "frequency": 2, "benefit": 1} for i, p in enumerate(patterns)], "texture": b"", "mesh": b"", "other": dicts[0] if dicts else b""})
    index = c.write(["list", c.ENTRY if version > 1 else c.ENTRY_V1], entries)
    start = c.HEADER_BYTES + 2 + len(words)
    head = {"magic": c.MAGIC, "version": version, "metadata_length": 2, "dictionary_length": len(words), "body_offset": start, "index_offset": start + len(body), "index_length": len(index)}
    path.write_bytes(c.write(c.HEADER, head) + b"{}" + words + body + index)


def test_chunks(spark, tmp_path, made):
    a, mesh = made["random"](1, 3000), made["mesh"]()
    parts = [zstandard.compress(a[:1000]), a[1000:], zstandard.compress(encode_buffer(mesh))]
    at = [0, len(parts[0]), len(parts[0]) + len(parts[1])]
    chunk = lambda k, size, packed: {"chunk_hash": 2**63 + k, "body_offset": at[k], "body_length": len(parts[k]), "uncompressed_length": size, "compressed": packed}
    entries = [entry("a.bin", a, chunks=[chunk(0, 1000, True), chunk(1, 2000, False)]), entry("m.mesh", mesh, asset_type=1, pre_encoding=1, chunks=[chunk(2, len(mesh), True)]), entry("copy.bin", a, duplicate_of="a.bin"), entry("empty", b"")]
    path = tmp_path / "x.pack"
    save(path, 3, entries, b"".join(parts))
    opened = c.open_container(str(path))
    listed = {r["path"]: r for r in listing.entries(c.index_table(spark, opened)).collect()}
    assert listed["a.bin"]["compressed_bytes"] == len(parts[0]) + 2000 and listed["copy.bin"]["ratio"] == 0
    found = {r["relative_path"]: (None if r["content"] is None else bytes(r["content"]), r["reason"]) for r in c.container_contents(spark, str(path), opened).collect()}
    assert found == {"a.bin": (a, None), "m.mesh": (mesh, None), "empty": (b"", None)}
    data = bytearray(path.read_bytes())
    data[opened["header"]["body_offset"] + at[1] + 5] ^= 255
    path.write_bytes(bytes(data))
    assert {r["relative_path"] for r in c.container_contents(spark, str(path)).where("reason is not null").collect()} == {"a.bin"}


def test_version_1(spark, tmp_path):
    data = b"abcPATTERNdef"
    body = zstandard.compress(c.write("Q", 3) + c.write("I", 0) + c.write("bytes", b"abc") + c.write("I", 1) + c.write("I", 0) + c.write("I", 0) + c.write("bytes", b"def"))
    path = tmp_path / "old.pack"
    save(path, 1, [entry("t", data, compressed_length=len(body))], body, [b"PATTERN"])
    opened = c.open_container(str(path))
    assert bytes(c.container_contents(spark, str(path), opened).first()["content"]) == data
    assert opened["index"][0]["chunks"] == [] and c.patterns_table(spark, opened).count() == 1


@pytest.mark.parametrize("damage", [lambda d: b"XXXX" + d[4:], lambda d: d[:20], lambda d: d[:-1], lambda d: d[:22] + b"\xff" * 8 + d[30:]])
def test_damaged_heads(tmp_path, damage):
    path = tmp_path / "bad.pack"
    save(path, 3, [entry("empty", b"")], b"")
    path.write_bytes(damage(path.read_bytes()))
    with pytest.raises(c.Corrupt):
        c.open_container(str(path))
