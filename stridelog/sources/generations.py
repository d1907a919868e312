"""Sets of tables that are published as a whole.

A run writes all its tables to a folder of its own and then adds one small manifest that names them. The
manifest appears by a rename, which happens or does not: a reader sees the old set or the new one, never
half of each, and a run that is killed leaves no trace but files that nobody names. A reader holds the
generation it opened until it opens another.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import remove
from .writers import Written

MANIFESTS = "_manifests"


@dataclass(frozen=True)
class Generation:
    """One published set: where its tables are, and the rows and bytes of each."""

    folder: str
    number: int
    data: str
    tables: Mapping[str, Written]

    def path(self, name: str) -> str:
        if name not in self.tables:
            raise KeyError(f"generation {self.number} has no table {name!r}, only {sorted(self.tables)}")
        return f"{self.folder}/{self.data}/{name}"

    def table(self, spark: SparkSession, name: str, fmt: str = "parquet") -> DataFrame:
        return spark.read.format(fmt).load(self.path(name))


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The published generations, oldest first."""
    path, files = _files(spark, f"{folder.rstrip('/')}/{MANIFESTS}")
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def current(spark: SparkSession, folder: str, number: int | None = None) -> Generation:
    """The newest generation, or the one with that number."""
    folder = folder.rstrip("/")
    known = numbers(spark, folder)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"no generation {'' if number is None else number} is published in {folder}")
    number = known[-1] if number is None else number
    path, files = _files(spark, f"{folder}/{MANIFESTS}/{number:08d}.json")
    stream = files.open(path)
    try:
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Generation(folder, number, told["data"], {k: Written(**v) for k, v in told["tables"].items()})


def publish(spark: SparkSession, folder: str, write: Callable[[str], Mapping[str, Written]]) -> Generation:
    """Let `write` fill a new folder with tables and make them the newest generation.

    If `write` fails, or another run publishes the same number first, the generations are as they were.
    """
    folder = folder.rstrip("/")
    known = numbers(spark, folder)
    number = known[-1] + 1 if known else 1
    data = f"data/{number:08d}-{uuid.uuid4().hex}"
    made = Generation(folder, number, data, dict(write(f"{folder}/{data}")))
    _switch(spark, made)
    return made


def _switch(spark: SparkSession, made: Generation) -> None:
    """The manifest is written under a name that no reader looks at, then renamed; an existing one stays."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, files = _files(spark, f"{made.folder}/{MANIFESTS}/{made.number:08d}.json")
    draft = hadoop.Path(f"{made.folder}/{MANIFESTS}/_{uuid.uuid4().hex}.draft")
    stream = files.create(draft, False)
    try:
        told = {"data": made.data, "tables": {k: asdict(v) for k, v in made.tables.items()}}
        stream.write(bytearray(json.dumps(told).encode()))
    finally:
        stream.close()
    context = hadoop.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    context.rename(draft, final, spark.sparkContext._gateway.new_array(rename, 0))


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Remove all but the newest `keep` generations; readers of those fail. The manifest goes first."""
    gone = numbers(spark, folder)[: -max(keep, 1)]
    for number in gone:
        old = current(spark, folder, number)
        remove(spark, f"{old.folder}/{MANIFESTS}/{number:08d}.json")
        remove(spark, f"{old.folder}/{old.data}")
    return gone
