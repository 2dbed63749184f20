"""Tables that change together: Parquet files in the shared store, and a manifest for each version.

A table is kept in ``parts`` by a hash of its key. A change writes new files for the parts it touches, of as many
tables as it likes, and becomes visible at once with one small file, ``versions/<n>.json``, that lists the files of all
parts. A writer that dies before that leaves files which no version names. Readers hold on to a version;
files of parts that did not change keep their names from version to version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.shared import cut, remove, shared_path

END = "//"


class Conflict(RuntimeError):
    """Another writer has published a version since this change began."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def fresh(spark: SparkSession, name: str) -> Store:
        return Store(spark, shared_path(spark, name))

    # ---- manifests ----

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def _numbers(self) -> list[int]:
        if not self.exists("versions"):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(self._path("versions")) if s.getPath().getName().endswith(".json"))

    def _text(self, number: int) -> str:
        stream = self._fs.open(self._path(f"versions/{number:012}.json"))
        try:
            return str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """The published versions; a manifest that its writer did not finish is none."""
        return [n for n in self._numbers() if self._text(n).endswith(END)]

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "tables": {}, "marks": {}}
            version = known[-1]
        return json.loads(self._text(version).removesuffix(END))

    def publish(self, manifest: dict, base: int) -> int:
        """Write the next manifest, where no other version has come after ``base``."""
        numbers = self._numbers()
        if any(n > base for n in self.versions()):
            raise Conflict(f"a version came after {base}")
        number = max([base, *numbers]) + 1
        # fails where the file exists: of two writers, one wins
        out = self._fs.create(self._path(f"versions/{number:012}.json"), False)
        try:
            out.write(bytearray((json.dumps(manifest | {"version": number}) + END).encode()))
        finally:
            out.close()
        return number

    # ---- tables ----

    def create(self, **tables: tuple[str, list[str], int]) -> int:
        """New empty tables: name = (schema, key columns, parts)."""
        m = self.manifest()
        for name, (schema, key, parts) in tables.items():
            m["tables"][name] = {"schema": schema, "key": key, "parts": parts, "dirs": {}}
        return self.publish(m, m["version"])

    def _files(self, t: dict, parts: list[int] | None = None) -> DataFrame:
        wanted = None if parts is None else set(parts)
        dirs = [f"{self.root}/{d}" for p, ds in t["dirs"].items() if wanted is None or int(p) in wanted for d in ds]
        if not dirs:
            return self.spark.createDataFrame([], t["schema"])
        return self.spark.read.schema(t["schema"]).parquet(*dirs)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._files(self.manifest(version)["tables"][table])

    def read_parts(self, table: str, parts: list[int], version: int | None = None) -> DataFrame:
        """Only the folders of these parts are listed and read."""
        return self._files(self.manifest(version)["tables"][table], parts)

    def files(self, table: str, version: int | None = None) -> dict[int, list[str]]:
        """The folders of each part."""
        return {int(p): ds for p, ds in self.manifest(version)["tables"][table]["dirs"].items()}

    def marks(self, version: int | None = None) -> dict[str, str]:
        return self.manifest(version)["marks"]

    @contextmanager
    def change(self) -> Iterator[Change]:
        """What is done to the tables inside is published at the end, all of it or, on an error, nothing."""
        c = Change(self)
        yield c
        c.publish()

    def vacuum(self, keep: int = 1) -> int:
        """Drop all but the last ``keep`` versions and every folder that those do not name; returns the folders dropped."""
        known = self.versions()
        for n in [n for n in self._numbers() if n not in known[-keep:]]:
            self._fs.delete(self._path(f"versions/{n:012}.json"), False)
        used = {d.split("/")[1] for n in known[-keep:] for t in self.manifest(n)["tables"].values() for ds in t["dirs"].values() for d in ds}
        gone = [s.getPath().getName() for s in self._fs.listStatus(self._path("data")) if s.getPath().getName() not in used] if self.exists("data") else []
        for name in gone:
            remove(self.spark, f"{self.root}/data/{name}")
        return len(gone)


class Change:
    """New files of some tables, not yet visible."""

    def __init__(self, store: Store):
        self.store, self.manifest = store, store.manifest()
        self.base, self.touched = self.manifest["version"], {}

    def mark(self, name: str, value: str) -> None:
        """A note that is published with the change, and only with it: what has been done already."""
        if self.manifest["marks"].get(name) != value:
            self.manifest["marks"][name] = value
            self.touched.setdefault("", 0)

    def _part(self, t: dict) -> Column:
        return F.pmod(F.xxhash64(*t["key"]), F.lit(t["parts"])).cast("int")

    def read(self, table: str) -> DataFrame:
        return self.store._files(self.manifest["tables"][table])

    def upsert(self, table: str, rows: DataFrame) -> int:
        """Rows by key: new ones are added, others replaced; of rows with one key the greatest counts. Returns the parts rewritten.

        Rows that are stored already as they are change nothing, so that a repeated change writes no files.
        """
        t = self.manifest["tables"][table]
        names = [f.split()[0] for f in t["schema"].split(", ")]
        rest = [n for n in names if n not in t["key"]]
        kinds = self.store.spark.createDataFrame([], t["schema"]).schema
        rows = rows.select(*[F.col(n).cast(kinds[n].dataType).alias(n) for n in names])
        new = rows.groupBy(*t["key"]).agg(F.max(F.struct(*rest)).alias("_new"))
        if not t["dirs"]:  # all keys are new
            return self.put_parts(table, new.select(*t["key"], "_new.*").select(*names, self._part(t).alias("part")), "part")
        old = self.read(table).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(t["key"])], F.struct(*rest).alias("_old"))
        on = F.lit(True)
        for i, k in enumerate(t["key"]):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        other = new.join(old, on, "left").where(~F.col("_new").eqNullSafe(F.col("_old")))
        other = cut(other.select(*t["key"], "_new.*").select(*names, self._part(t).alias("part")), "change", stay=True)
        return self._rewrite(table, other)

    def put_parts(self, table: str, rows: DataFrame, part: str) -> int:
        """Adds rows, whose keys are new, to the parts that the column ``part`` names; files that are there stay. Returns the parts that grow."""
        t = self.manifest["tables"][table]
        folder = f"data/{table}-{uuid.uuid4().hex}"
        rows.withColumn("part", F.col(part)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.store.root}/{folder}")
        grown = [n.split("=")[1] for s in self.store._fs.listStatus(self.store._path(folder)) if (n := s.getPath().getName()).startswith("part=")]
        for p in grown:
            t["dirs"].setdefault(p, []).append(f"{folder}/part={p}")
        if grown:
            self.touched[table] = self.touched.get(table, 0) + len(grown)
        else:
            remove(self.store.spark, f"{self.store.root}/{folder}")
        return len(grown)

    def update(self, table: str, column: str, value: Column) -> int:
        """``column``, no part of the key, of every row becomes ``value``; parts in which that changes nothing stay. Returns the parts rewritten.

        Keys do not change, so rows stay in their parts: nothing is grouped, joined or compared across rows.
        """
        t = self.manifest["tables"][table]
        own = self.store.spark.createDataFrame([], t["schema"]).schema[column].dataType
        rows = self.read(table).withColumn("part", self._part(t))
        due = rows.where(~value.cast(own).eqNullSafe(F.col(column)))
        parts = sorted(r["part"] for r in due.select("part").distinct().collect())  # as many as the table's parts at most
        if not parts:
            return 0
        return self._put(table, self.store._files(t, parts).withColumn(column, value.cast(own)).withColumn("part", self._part(t)), parts)

    def delete(self, table: str, keys: DataFrame) -> int:
        t = self.manifest["tables"][table]
        met = self.read(table).join(keys.select(*t["key"]).distinct(), t["key"], "left_semi")
        return self._rewrite(table, cut(met.withColumn("part", self._part(t)), "change", stay=True), gone=True)

    def _rewrite(self, table: str, other: DataFrame, gone: bool = False) -> int:
        t = self.manifest["tables"][table]
        parts = sorted(r["part"] for r in other.select("part").distinct().collect())  # as many as the table's parts at most
        if not parts:
            return 0
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(t["key"])]
        keys = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(t["key"])])
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        kept = self.store._files(t, parts).join(keys, cond, "left_anti").withColumn("part", self._part(t))
        return self._put(table, kept if gone else kept.unionByName(other), parts)

    def _put(self, table: str, out: DataFrame, parts: list[int]) -> int:
        """``out`` (with ``part``) becomes all that these parts hold."""
        t, folder = self.manifest["tables"][table], f"data/{table}-{uuid.uuid4().hex}"
        # one file for a part, more where the part is large
        out.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.store.root}/{folder}")
        for p in parts:
            t["dirs"].pop(str(p), None)
            if self.store.exists(f"{folder}/part={p}"):
                t["dirs"][str(p)] = [f"{folder}/part={p}"]
        self.touched[table] = self.touched.get(table, 0) + len(parts)
        return len(parts)

    def publish(self) -> int:
        """The new version, or the old one if nothing changed."""
        return self.store.publish(self.manifest, self.base) if self.touched else self.base
