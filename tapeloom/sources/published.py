"""Sets of tables that become visible together.

Every table of a set is written below its own new folder; a manifest that names the
folders is renamed into place last.  Readers look at the newest manifest only, so a
writer that fails at any table leaves the former set as it was, and a reader never sees
tables of two sets.  A rename onto an existing manifest fails: of two writers one wins
and the other is told.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_PREFIX, _DIGITS = "manifest-", 10


class Conflict(RuntimeError):
    """Another writer published first."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function from text to its paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, path = _files(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return sorted(int(n[len(_PREFIX) :]) for n in names if n.startswith(_PREFIX) and n[len(_PREFIX) :].isdigit())


def _named(root: str, number: int) -> str:
    return f"{root}/{_PREFIX}{number:0{_DIGITS}d}"


def current(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """The newest manifest (or an older one): ``number``, ``tables`` (name to folders) and ``note``; number -1 without any."""
    numbers = _numbers(spark, root)
    if not numbers:
        return {"number": -1, "tables": {}, "note": {}}
    wanted = numbers[-1] if number is None else number
    fs, path = _files(spark, root)
    stream = fs.open(path(_named(root, wanted)))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) | {"number": wanted}


def commit(spark: SparkSession, root: str, seen: int, tables: dict[str, list[str]], note: dict | None = None) -> int:
    """Put a manifest after number ``seen``; ``Conflict`` if another one is there already."""
    fs, path = _files(spark, root)
    fs.mkdirs(path(root))
    draft = path(f"{root}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    try:
        stream.write(bytearray(json.dumps({"tables": tables, "note": note or {}}).encode()))
    finally:
        stream.close()
    if fs.exists(path(_named(root, seen + 1))) or not fs.rename(draft, path(_named(root, seen + 1))):
        fs.delete(draft, False)
        raise Conflict(f"manifest {seen + 1} of {root} is another writer's")
    return seen + 1


def publish(spark: SparkSession, root: str, writers: dict[str, Callable[[str], None]], note: dict | None = None) -> int:
    """Run every writer with a new folder of its own, then publish all of them as one set; returns its number.

    If a writer fails the error is passed on, what was written stays invisible and the former set is current.
    """
    seen = current(spark, root)["number"]
    folders = {name: f"data/{name}-{uuid.uuid4().hex}" for name in writers}
    for name, write in writers.items():
        write(f"{root}/{folders[name]}")
    return commit(spark, root, seen, {name: [folder] for name, folder in folders.items()}, note)


def published(spark: SparkSession, root: str, name: str, schema, kind: str = "parquet", number: int | None = None, **options) -> DataFrame:
    """A table of the current (or an older) set; without such a table a table without rows."""
    folders = current(spark, root, number)["tables"].get(name, [])
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.format(kind).schema(schema).options(**options).load([f"{root}/{f}" for f in folders])


def sweep(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the last ``keep`` sets names, and older manifests; returns their names.

    Folders of a writer that is still at work are named by no set: sweep when none is.
    """
    fs, path = _files(spark, root)
    numbers = _numbers(spark, root)
    kept = {f.removeprefix("data/") for n in numbers[-keep:] for folders in current(spark, root, n)["tables"].values() for f in folders}
    gone = []
    if fs.exists(path(f"{root}/data")):
        for status in fs.listStatus(path(f"{root}/data")):
            name = status.getPath().getName()
            if name not in kept:
                fs.delete(status.getPath(), True)
                gone.append(name)
    for n in numbers[:-keep]:
        fs.delete(path(_named(root, n)), False)
    return gone


def appended(spark: SparkSession, root: str, name: str, df: DataFrame, partition: Sequence[str] = (), tries: int = 5) -> int:
    """Add a folder with the rows of ``df`` to a table: committed rows are never written again, and all become visible at once."""
    folder = f"data/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(f"{root}/{folder}")
    for _ in range(tries):
        now = current(spark, root)
        tables = now["tables"] | {name: [*now["tables"].get(name, []), folder]}
        try:
            return commit(spark, root, now["number"], tables, now.get("note"))
        except Conflict:
            continue  # another writer's rows are in the newer manifest: add to that one
    raise Conflict(f"{root} changes too often")


def compacted(spark: SparkSession, root: str, name: str, schema, rows: Callable[[DataFrame], DataFrame], files: int) -> int:
    """Replace the folders of a table by one with ``files`` files; ``rows`` may drop what is superseded."""
    now = current(spark, root)
    folder = f"data/{name}-{uuid.uuid4().hex}"
    table = published(spark, root, name, schema, number=now["number"]) if now["number"] >= 0 else spark.createDataFrame([], schema)
    rows(table).repartition(files).write.parquet(f"{root}/{folder}")
    return commit(spark, root, now["number"], now["tables"] | {name: [folder]}, now.get("note"))
