"""The codec benchmark has a row for every level."""

from packloom import queries


def test_benchmark_levels(spark):
    found = {r["codec"]: r["compressed_bytes"] for r in queries.QUERIES["e14_codec_benchmark"](spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == {"zstd-3", "zstd-9", "zstd-19", "zstd-3-mesh-delta"} and 0 < found["zstd-19"] <= found["zstd-3"]


def test_benchmark_of_packages(spark):
    """The benchmark verb has the codecs and two packages; a package holds a file's bytes."""
    rows = {r["codec"]: r for r in queries.QUERIES["j6_benchmark"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == {"zstd-3", "zstd-9", "zstd-19", "zstd-3-mesh-delta", "package-baseline", "package-optimised"}
    assert len({r["input_bytes"] for r in rows.values()}) == 1 and all(r["compressed_bytes"] > 0 for r in rows.values())
