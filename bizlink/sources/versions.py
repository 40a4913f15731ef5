"""Tables in parts with versions: copy on write, a pointer swapped last, readers on a snapshot.

A version is a small JSON manifest that names, for every table and part, the folder that holds
it. Writing puts new folders beside the old ones and then the manifest under its number, by a
rename; until then readers see the version before, and a writer that dies leaves nothing but
folders that the next try replaces. Old folders stay until :meth:`VersionedTables.vacuum`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTables:
    """``tables`` maps names to schemas; each has a string column ``key`` that gives the part."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], parts: int) -> None:
        self.spark, self.path, self.schemas, self.parts = spark, path.rstrip("/"), tables, parts

    def _files(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}.json"

    def numbers(self) -> list[int]:
        """Committed versions, oldest first."""
        files, at = self._files(f"{self.path}/manifests")
        if not files.exists(at):
            return []
        names = [f.getPath().getName() for f in files.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def has(self, number: int) -> bool:
        files, at = self._files(self._manifest(number))
        return files.exists(at)

    def latest(self) -> Version:
        """The newest committed version; it stays as it is while others are written."""
        numbers = self.numbers()
        return self.at(numbers[-1]) if numbers else Version(self, -1, {t: {} for t in self.schemas})

    def at(self, number: int) -> Version:
        text = self.spark.read.text(self._manifest(number), wholetext=True).first()[0]
        return Version(self, number, json.loads(text))

    def begin(self, base: Version, number: int) -> Version:
        """A version on top of ``base``, to be filled with ``put`` and committed."""
        if number <= base.number:
            raise ValueError(f"version {number} isn't newer than {base.number}")
        return Version(self, number, {t: dict(p) for t, p in base.folders.items()})

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders and manifests that the newest ``keep`` versions don't name."""
        numbers = self.numbers()
        needed = {f for n in numbers[-keep:] for parts in self.at(n).folders.values() for f in parts.values()}
        gone = 0
        for table in self.schemas:
            files, at = self._files(f"{self.path}/{table}")
            for version in files.listStatus(at) if files.exists(at) else ():
                for part in files.listStatus(version.getPath()):
                    name = f"{table}/{version.getPath().getName()}/{part.getPath().getName()}"
                    if part.isDirectory() and name not in needed and int(version.getPath().getName()[1:]) <= numbers[-1]:
                        gone += bool(files.delete(part.getPath(), True))
        for n in numbers[:-keep]:
            files, at = self._files(self._manifest(n))
            files.delete(at, False)
        return gone


class Version:
    """``folders``: for every table the folder of each part that has rows."""

    def __init__(self, tables: VersionedTables, number: int, folders: dict[str, dict[str, str]]) -> None:
        self.tables, self.number, self.folders = tables, number, folders

    def _part(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.tables.parts)).cast("int")

    def _touched(self, keys: DataFrame) -> list[str]:
        return [str(r[0]) for r in keys.select(self._part().alias("p")).distinct().collect()]  # at most one a part

    def _load(self, table: str, parts: list[str]) -> DataFrame:
        spark, schema = self.tables.spark, self.tables.schemas[table]
        folders = sorted(f"{self.tables.path}/{self.folders[table][p]}" for p in parts if p in self.folders[table])
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def read(self, table: str, keys: DataFrame | None = None, join: str = "merge") -> DataFrame:
        """The rows of a table, or those whose ``key`` is among the keys given: only the parts
        of these are read. Keys that grow with the input are joined by sorting: such a table is
        far smaller as a file than in the memory of the driver, which would broadcast it."""
        if keys is None:
            return self._load(table, list(self.folders[table]))
        return self._load(table, self._touched(keys)).join(keys.select("key").distinct().hint(join), "key", "left_semi")

    def read_hashed(self, table: str, hashes: DataFrame) -> DataFrame:
        """The rows whose ``key`` has one of the ``hash`` values given (``xxhash64``), with it."""
        parts = [str(r[0]) for r in hashes.select(F.pmod("hash", F.lit(self.tables.parts)).alias("p")).distinct().collect()]  # at most one a part
        return self._load(table, parts).withColumn("hash", F.xxhash64("key")).join(hashes.select("hash").distinct().hint("merge"), "hash", "left_semi")

    def put(self, table: str, rows: DataFrame, keep: list[str], gone: DataFrame | None = None) -> None:
        """Add rows, replacing those with the same ``keep`` columns if there are any, and drop the
        keys of ``gone``. Parts of other keys aren't read or written."""
        keys = rows.select("key") if gone is None else rows.select("key").unionByName(gone.select("key"))
        parts = self._touched(keys)
        if not parts:
            return
        old = self._load(table, parts)
        if gone is not None:
            old = old.join(gone.select("key").distinct().hint("merge"), "key", "left_anti")
        columns = old.columns
        if keep:
            rows = rows.select(*columns).dropDuplicates(keep)
            old = old.join(rows.select(*keep).hint("merge"), keep, "left_anti").select(*columns)
        whole = old.unionByName(rows.select(*columns))
        folder = f"{table}/v{self.number}"
        whole.withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.tables.path}/{folder}")
        files, at = self.tables._files(f"{self.tables.path}/{folder}")
        made = {f.getPath().getName().removeprefix("part=") for f in files.listStatus(at) if f.isDirectory()}
        for p in parts:
            if p in made:
                self.folders[table][p] = f"{folder}/part={p}"
            else:
                self.folders[table].pop(p, None)

    def commit(self) -> None:
        """Make this the newest version: the manifest is written aside and renamed."""
        target = self.tables._manifest(self.number)
        files, at = self.tables._files(target)
        _, aside = self.tables._files(f"{self.tables.path}/manifests/_{self.number:012d}.tmp")
        files.mkdirs(at.getParent())
        out = files.create(aside, True)
        out.write(bytearray(json.dumps(self.folders).encode()))
        out.close()
        if not files.rename(aside, at):
            raise RuntimeError(f"version {self.number} was committed by another writer")
