"""Commands: scan, analyze, compress, compress-incremental, list, verify, decompress, extract-file, benchmark, patch, apply-patch, key-gen, sign, verify-sig."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import listing
from .operators.integrity import Ed25519
from .plans import analyze, benchmark, package, patch
from .sources.assets import scan_assets
from .sources.config import load


def _show(df: DataFrame, as_json: bool) -> None:
    """Rows stream to the terminal one partition at a time."""
    for row in (analyze.as_json(df) if as_json else df).toLocalIterator():
        print(row[0] if as_json else "\t".join("" if v is None else str(v) for v in row))


def _key(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read()
    if len(data) != 32:
        raise ValueError(f"a key file holds 32 bytes: {path}")
    return data


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="packloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **flags: type | None) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for x in positional:
            s.add_argument(x)
        s.add_argument("--json", action="store_true")
        for flag, kind in flags.items():
            s.add_argument("--" + flag.replace("_", "-"), **({"type": kind} if kind else {"action": "store_true"}))
        return s

    add("scan", "folder")
    add("analyze", "folder")
    add("compress", "folder", output=str, config=str)
    add("compress-incremental", "folder", "previous", output=str, config=str)
    add("list", "package", sort_size=None, search=str)
    add("verify", "package", verbose=None)
    add("decompress", "package", output=str)
    add("extract-file", "package", "path", output=str)
    add("benchmark", "folder", no_zstd19=None)
    add("patch", "old", "new", output=str)
    add("apply-patch", "old", "patch", output=str)
    add("key-gen", "private", "public")
    add("sign", "package", "private", "public")
    add("verify-sig", "package", key=str)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("packloom").getOrCreate()
    if a.command == "scan":
        _show(scan_assets(spark, a.folder).drop("content"), a.json)
    elif a.command == "analyze":
        for part in analyze.report(scan_assets(spark, a.folder)).values():
            _show(part, a.json)
    elif a.command == "compress":
        package.build(scan_assets(spark, a.folder), a.output, load(a.config))
    elif a.command == "compress-incremental":
        _show(package.build_incremental(scan_assets(spark, a.folder), a.previous, a.output, load(a.config)).groupBy("action").count(), a.json)
    elif a.command == "list":
        rows = listing.entries(package.open_package(spark, a.package)["index"])
        rows = listing.search(rows, a.search or "")
        _show(listing.by_size(rows) if a.sort_size else listing.by_path(rows), a.json)
    elif a.command == "verify":
        checked = package.verify(package.open_package(spark, a.package)).persist()
        _show(checked if a.verbose else checked.where("not ok"), a.json)
        return int(not checked.where("not ok").isEmpty())
    elif a.command in ("decompress", "extract-file"):
        tables, root = package.open_package(spark, a.package), os.path.abspath(a.output)
        wrote = package.extract_to(tables, root) if a.command == "decompress" else package.write_files(package.extract_file(tables, a.path).withColumnRenamed("name", "relative_path"), root)
        failed = wrote.where("not ok").persist()  # files are written once
        _show(failed, a.json)
        return int(not failed.isEmpty())
    elif a.command == "benchmark":
        _show(benchmark.run(scan_assets(spark, a.folder), (3, 9) if a.no_zstd19 else (3, 9, 19)), a.json)
    elif a.command == "patch":
        patch.write_patch(spark, patch.build_patch(scan_assets(spark, a.old), scan_assets(spark, a.new)), a.output)
    elif a.command == "apply-patch":
        made = patch.apply_patch(scan_assets(spark, a.old), *patch.open_patch(spark, a.patch))
        rows = made.select("relative_path", "content", F.when(~F.col("ok"), "hash mismatch").alias("reason"))
        failed = package.write_files(rows, os.path.abspath(a.output)).where("not ok").persist()
        _show(failed, a.json)
        return int(not failed.isEmpty())
    elif a.command == "key-gen":
        for path, key in zip((a.private, a.public), Ed25519(spark).generate(), strict=True):
            with open(path, "wb") as file:
                file.write(key)
    elif a.command == "sign":
        package.sign(spark, a.package, _key(a.private), _key(a.public))
    else:
        try:
            print(package.verify_signature(spark, a.package, _key(a.key) if a.key else None).hex())
        except ValueError as error:
            print(error, file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
