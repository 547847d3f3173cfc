"""Tables that are reloaded while others read them: versions, and a manifest that is written last.

    TABLE/_versions/<number>-<random>/   the files of one version, never changed once named
    TABLE/_manifests/<number>.json       which folder a version is, its rows and schema

A load writes a folder of its own, counts what it wrote, and only then puts the manifest, by a
rename that fails if the number is taken: a load that ends halfway leaves the table as it
was, and of two loads at once one is refused. A reader resolves the newest manifest once; its frame goes on
reading that version, whatever is loaded meanwhile. ``expire`` removes versions by the
time since they were replaced, and the folders of loads that never ended.

All files are reached through the store's own Hadoop file system.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSIONS, MANIFESTS = "_versions", "_manifests"


class ReloadConflict(RuntimeError):
    """Another load has put the same version meanwhile."""


@dataclass(frozen=True)
class Manifest:
    version: int
    folder: str  # under the table's folder
    rows: int
    written_at: float  # seconds since 1970
    schema: str  # JSON

    def path(self, table: str) -> str:
        return f"{table.rstrip('/')}/{VERSIONS}/{self.folder}"


def _store(spark: SparkSession, path: str):
    """The Hadoop file system and path of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since 1970 of the last change) of what a folder holds; nothing if there is none."""
    fs, p = _store(spark, path)
    if not fs.exists(p):
        return []
    return sorted((f.getPath().getName(), f.getModificationTime() / 1000) for f in fs.listStatus(p))


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _store(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole under its name, or fail if the name is taken."""
    fs, p = _store(spark, path)
    _, part = _store(spark, f"{path[: path.rindex('/')]}/_{uuid.uuid4().hex}.part")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise ReloadConflict(f"{path} was written by another load")


def manifests(spark: SparkSession, table: str) -> list[Manifest]:
    """All versions, oldest first; files that are no whole manifest are passed over."""
    found = []
    for name, _ in _listed(spark, f"{table.rstrip('/')}/{MANIFESTS}"):
        if name.endswith(".json") and not name.startswith("_"):
            try:
                found.append(Manifest(**json.loads(_read(spark, f"{table.rstrip('/')}/{MANIFESTS}/{name}"))))
            except (ValueError, TypeError):
                continue
    return sorted(found, key=lambda m: m.version)


def newest(spark: SparkSession, table: str) -> Manifest | None:
    found = manifests(spark, table)
    return found[-1] if found else None


def commit(
    spark: SparkSession, table: str, write: Callable[[str], object], check: Callable[[int], None] | None = None
) -> Manifest:
    """Let ``write`` fill a new folder, and make it the table's newest version.

    ``check`` gets the number of rows written and may raise; the table then stays as it was.
    """
    last = newest(spark, table)
    number = last.version + 1 if last else 1
    folder = f"{number:010d}-{uuid.uuid4().hex[:12]}"
    path = f"{table.rstrip('/')}/{VERSIONS}/{folder}"
    write(path)
    written = spark.read.parquet(path)
    rows = written.count()
    if check is not None:
        check(rows)
    made = Manifest(number, folder, rows, time.time(), written.schema.json())
    _put(spark, f"{table.rstrip('/')}/{MANIFESTS}/{number:010d}.json", json.dumps(asdict(made)))
    return made


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for; its schema comes from the manifest, not from the files."""
    found = manifests(spark, table)
    if version is not None:
        found = [m for m in found if m.version == version]
    if not found:
        raise FileNotFoundError(f"{table} has no {'version' if version is None else f'version {version}'}")
    return spark.read.schema(T.StructType.fromJson(json.loads(found[-1].schema))).parquet(found[-1].path(table))


def expire(spark: SparkSession, table: str, older_than: float, keep: int = 1, now: float | None = None) -> list[str]:
    """Remove versions that were replaced more than ``older_than`` seconds ago, but for the newest ``keep``.

    Folders that no manifest names, of loads that failed, go once they are as old. Give a time that is
    longer than any reader or load takes. Returns the folders removed.
    """
    if keep < 1:
        raise ValueError("the newest version stays: keep at least 1")
    now = time.time() if now is None else now
    known, root, removed = manifests(spark, table), table.rstrip("/"), []
    for old, after in zip(known[:-keep], known[1:]):
        if now - after.written_at > older_than:
            # the manifest goes first: no reader finds a version whose files are going
            for path in (f"{root}/{MANIFESTS}/{old.version:010d}.json", old.path(table)):
                fs, p = _store(spark, path)
                fs.delete(p, True)
            removed.append(old.folder)
    named = {m.folder for m in known}
    for name, changed in _listed(spark, f"{root}/{VERSIONS}"):
        if name not in named and now - changed > older_than:
            fs, p = _store(spark, f"{root}/{VERSIONS}/{name}")
            fs.delete(p, True)
            removed.append(name)
    return removed
