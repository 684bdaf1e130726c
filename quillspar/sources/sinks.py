"""Write semantics over Parquet tables: append, upsert, insert-if-absent, versions, receipts.

A table is a folder of Parquet files and a log of numbered manifests, each of
which lists the files of one version and the receipts of the chunks in it. A
writer adds files, then creates the next manifest; creating fails if the number is
taken, and the writer starts again from that one. So readers see one version or
the next, no version is ever changed, and a writer that is lost on the way leaves
files that no manifest names. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPTS = 20
#: Seconds that a manifest may take to be written; one unfinished for longer is that of a lost writer.
PATIENCE = 30.0


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    schema: str | None = None
    files: tuple[str, ...] = ()
    chunks: dict[str, dict] = field(default_factory=dict)


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of keys in which nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return out


class ParquetTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    # ---- versions

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _number_file(self, number: int) -> str:
        return f"log/{number:012d}.json"

    def _manifest(self, number: int) -> Manifest | None:
        """A manifest, or none if its writer hasn't finished it."""
        fs, path = self._fs(self._number_file(number))
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if not text.endswith("\n"):
            return None
        got = json.loads(text)
        return Manifest(number, got["schema"], tuple(got["files"]), got["chunks"])

    def latest(self, wait: bool = False) -> Manifest:
        """The newest finished version; with ``wait`` unfinished ones are waited for."""
        fs, path = self._fs("log")
        if not fs.exists(path):
            return Manifest()
        numbers = sorted((int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")), reverse=True)
        for number in numbers:
            until = time.monotonic() + (PATIENCE if wait else 0)
            while (found := self._manifest(number)) is None and time.monotonic() < until:
                time.sleep(0.2)
            if found is not None:
                return replace(found, number=max(numbers)) if wait else found
        return Manifest(number=max(numbers, default=0))

    def _put(self, manifest: Manifest) -> bool:
        """Create the manifest; False if another writer has its number."""
        fs, path = self._fs(self._number_file(manifest.number))
        body = json.dumps({"schema": manifest.schema, "files": list(manifest.files), "chunks": manifest.chunks}) + "\n"
        try:
            out = fs.create(path, False)
        except Py4JJavaError as error:
            if fs.exists(path):
                return False
            raise error
        out.write(bytearray(body.encode()))
        out.close()
        return True

    def commit(self, change: Callable[[Manifest], Manifest | None]) -> bool:
        """Put what ``change`` makes of the newest version; it is asked again if another writer was faster. False if it makes nothing."""
        for _ in range(ATTEMPTS):
            base = self.latest(wait=True)
            new = change(base)
            if new is None:
                return False
            if self._put(replace(new, number=base.number + 1)):
                return True
        raise RuntimeError(f"{self.path}: {ATTEMPTS} other writers were faster")

    # ---- rows

    def write_files(self, rows: DataFrame) -> tuple[str, ...]:
        """New files with these rows, which no version names yet."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        fs, path = self._fs(name)
        return tuple(sorted(f"{name}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")))

    def rows_of(self, manifest: Manifest, files: Sequence[str] | None = None) -> DataFrame | None:
        if manifest.schema is None:
            return None
        schema, files = T.StructType.fromJson(json.loads(manifest.schema)), manifest.files if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self) -> DataFrame | None:
        return self.rows_of(self.latest())

    def append(self, rows: DataFrame) -> None:
        """Add files; those there are stay as they are."""
        files, schema = self.write_files(rows), rows.schema.json()
        self.commit(lambda base: replace(base, schema=base.schema or schema, files=base.files + files))

    def one_per_key(self, rows: DataFrame, version: Sequence[str] = ()) -> DataFrame:
        """The row of the highest version of each key; without versions, and among equal ones, the greatest row."""
        rest = [c for c in rows.columns if c not in self.keys]
        if not rest:
            return rows.distinct()
        best = F.max(F.struct(*version, F.struct(*rest).alias("_row")))
        return rows.groupBy(*self.keys).agg(best.alias("_best")).select(*self.keys, "_best._row.*").select(*rows.columns)

    def upsert(self, rows: DataFrame, version: Sequence[str] = ()) -> None:
        """Rows replace those of their keys (null keys are equal); only files that hold such keys are written anew."""
        new = self.write_files(self.one_per_key(rows, version))
        schema = rows.schema.json()

        def change(base: Manifest) -> Manifest:
            old = self.rows_of(base)
            if old is None or not base.files:
                return replace(base, schema=base.schema or schema, files=base.files + new)
            keys = self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/{f}" for f in new]).select(*self.keys).alias("n")
            hit = old.withColumn("_file", F.col("_metadata.file_path")).alias("o").join(keys, same("o", "n", self.keys), "left_semi").select("_file").distinct()
            names = {r._file.rsplit("/data/", 1)[1] for r in hit.collect()}  # names of files
            touched = [f for f in base.files if f.removeprefix("data/") in names]
            stay = tuple(f for f in base.files if f not in set(touched))
            kept = self.write_files(self.rows_of(base, touched).alias("o").join(keys, same("o", "n", self.keys), "left_anti")) if touched else ()
            return replace(base, files=stay + kept + new)

        self.commit(change)

    def insert_absent(self, rows: DataFrame) -> None:
        """Rows whose keys are not there yet, one of each key."""
        new = self.one_per_key(rows)

        def change(base: Manifest) -> Manifest:
            old = self.rows_of(base)
            fresh = new if old is None else new.alias("n").join(old.select(*self.keys).alias("o"), same("n", "o", self.keys), "left_anti")
            return replace(base, schema=base.schema or rows.schema.json(), files=base.files + self.write_files(fresh))

        self.commit(change)

    def changed(self, rows: DataFrame) -> DataFrame:
        """Rows that differ from what is stored, or are not stored."""
        old = self.read()
        if old is None:
            return rows
        rest = [c for c in rows.columns if c not in self.keys]
        stored = old.select(*self.keys, F.struct(*rest).alias("_old")).alias("o")
        met = rows.alias("n").join(stored, same("n", "o", self.keys), "left")
        return met.where(~F.struct(*[F.col(f"n.`{c}`") for c in rest]).eqNullSafe(F.col("_old"))).select("n.*")

    def upsert_changed(self, rows: DataFrame) -> int:
        """Upsert of what changed; nothing is written if nothing did."""
        new = self.changed(rows).persist()
        n = new.count()
        if n:
            self.upsert(new)
        new.unpersist()
        return n

    def vacuum(self) -> int:
        """Delete files that the newest version doesn't name; for when no other writer or reader of old versions is there."""
        fs, path = self._fs("data")
        named, gone = set(self.latest().files), 0
        for folder in fs.listStatus(path) if fs.exists(path) else []:
            for s in fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{s.getPath().getName()}"
                if name.endswith(".parquet") and name not in named:
                    gone += bool(fs.delete(s.getPath(), False))
        return gone


class Receipts:
    """A build by chunks of [low, high): rows and receipt of a chunk appear in the table at once, after its check."""

    def __init__(self, table: ParquetTable):
        self.table = table

    def receipts(self) -> dict[str, dict]:
        return self.table.latest().chunks

    def done(self, chunk: str) -> bool:
        return chunk in self.receipts()

    def missing(self, chunks: Sequence[str]) -> list[str]:
        """What a stopped build has still to do."""
        have = self.receipts()
        return [c for c in chunks if c not in have]

    def run(self, chunk: str, low: int, high: int, build: Callable[[], DataFrame], check: Callable[[DataFrame], bool]) -> bool:
        """Build, check and publish a chunk unless it is done; False if it was, or failed its check.

        The check sees the rows as written. Receipts that overlap the interval are
        revoked, their rows with them, in the same version that publishes the chunk.
        """
        if self.done(chunk):
            return False
        rows = build()
        files, schema = self.table.write_files(rows), rows.schema.json()
        written = self.table.rows_of(Manifest(schema=schema, files=files))
        if not check(written):
            return False
        n = written.count()

        def change(base: Manifest) -> Manifest | None:
            if chunk in base.chunks:
                return None
            base = self._without(base, low, high)
            return replace(base, schema=base.schema or schema, files=base.files + files, chunks=base.chunks | {chunk: {"low": low, "high": high, "rows": n, "files": list(files)}})

        return self.table.commit(change)

    @staticmethod
    def _without(base: Manifest, low: int, high: int) -> Manifest:
        out = {c: r for c, r in base.chunks.items() if r["low"] < high and low < r["high"]}
        gone = {f for r in out.values() for f in r["files"]}
        return replace(base, files=tuple(f for f in base.files if f not in gone), chunks={c: r for c, r in base.chunks.items() if c not in out})

    def revoke(self, low: int, high: int) -> None:
        """Take back all chunks that overlap [low, high), rows and receipts."""
        self.table.commit(lambda base: self._without(base, low, high))


def sorted_zstd(df: DataFrame, path: str, order: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Sorted, compressed files: the sort makes their statistics prune."""
    df.sortWithinPartitions(*partition_by, *order).write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def bounded_parts(df: DataFrame, path: str, rows_a_part: int) -> DataFrame:
    """Files of at most ``rows_a_part`` rows and a receipt of each: part, rows, bytes, sha256."""
    spark = df.sparkSession
    df.write.option("maxRecordsPerFile", rows_a_part).parquet(path)
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("part")).agg(F.count("*").alias("rows"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).join(rows, "part", "left").na.fill({"rows": 0})
