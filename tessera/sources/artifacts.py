"""Artefacts that are published whole or not at all: a table with its manifest, and single files of text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.files import _fs, digest
from tessera.sources.outputs import canonical_json

MANIFEST = ".manifest.json"


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Source becomes target, which mustn't exist."""
    fs, a = _fs(spark, source)
    _, b = _fs(spark, target)
    if fs.exists(b):
        raise FileExistsError(target)
    if not fs.rename(a, b):
        raise OSError(f"{source} can't be renamed")


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an existing one is refused."""
    fs, at = _fs(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one piece; path or path.part, if there already, is refused and stays as it is."""
    for p in (path, f"{path}.part"):
        if exists(spark, p):
            raise FileExistsError(p)
    create(spark, f"{path}.part", text)
    try:
        rename(spark, f"{path}.part", path)
    finally:
        remove(spark, f"{path}.part")


def publish_pair(df: DataFrame, path: str, key: str, about: dict, writer: str = "parquet", **options: str) -> dict:
    """Publishes df at path, and beside it the manifest: about, the columns, the number of rows and their digest.

    Both are written as parts first, and the digest is of what was written.
    Then the table is renamed, and after it the manifest; if that fails, the
    table goes again. Anything that is there before is refused and stays.
    What a crash between the two leaves, recover() takes away: a table
    without a manifest was never published. key must be unique.
    """
    spark = df.sparkSession
    manifest_path = f"{path}{MANIFEST}"
    parts = f"{path}.part", f"{manifest_path}.part"
    for p in (path, manifest_path, *parts):
        if exists(spark, p):
            raise FileExistsError(p)
    named = ({"compression": "zstd", "parquet.block.row.count.limit": "100000"} if writer == "parquet" else {}) | options
    published = False
    try:
        df.write.format(writer).options(**named).save(parts[0])
        back = spark.read.schema(df.schema).format(writer).options(**options).load(parts[0])
        rows, code = digest(back, key)
        columns = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
        manifest = {"about": about, "columns": columns, "key": key, "rows": rows, "digest": code, "format": writer}
        create(spark, parts[1], canonical_json(manifest))
        rename(spark, parts[0], path)
        published = True
        rename(spark, parts[1], manifest_path)
        return manifest
    except BaseException:
        if published:
            remove(spark, path)
        raise
    finally:
        for p in parts:
            remove(spark, p)


def recover(spark: SparkSession, path: str) -> bool:
    """Takes away what a crash has left at path: parts, and a table without manifest; whether there was anything."""
    left = [p for p in (f"{path}.part", f"{path}{MANIFEST}.part") if exists(spark, p)]
    if exists(spark, path) and not exists(spark, f"{path}{MANIFEST}"):
        left.append(path)
    for p in left:
        remove(spark, p)
    return bool(left)


def read_pair(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A published table and its manifest; missing or other columns, rows or bytes are errors."""
    if not (exists(spark, path) and exists(spark, f"{path}{MANIFEST}")):
        raise FileNotFoundError(path)
    manifest = json.loads(spark.read.text(f"{path}{MANIFEST}", wholetext=True).first()[0])
    schema = ", ".join(f"`{c['name']}` {c['type']}" for c in manifest["columns"])
    df = spark.read.format(manifest["format"]).schema(schema).option("mode", "FAILFAST").load(path)
    if digest(df, manifest["key"]) != (manifest["rows"], manifest["digest"]):
        raise ValueError("the rows aren't those of the manifest")
    return df, manifest
