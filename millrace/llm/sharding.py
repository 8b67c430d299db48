"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and versioned manifests. An arrival is appended as small shards, one for
each task. Shards whose sizes are in the same tier (within a factor of FAN) are merged once FAN of them are there, into
files of about the target size; merged files come into higher tiers, up to the target, and are merged again there. A merge
packs whole shards into one task (coalesced, not shuffled), so rows are read and written once.

A version is committed by renaming its manifest into place without overwriting: it is there as a whole or not at all, and of
two writers of the same version one fails. Readers read the shards that the manifest of a version names; what an unfinished
append or merge wrote is in no manifest. vacuum() removes shards that no version which is kept names.

A manifest has a line for each shard: what the driver handles is the list of files, never rows.

Defined cases: nulls, empty and long texts, repeated rows and any columns are stored as they are; an empty arrival commits a
version without new shards; a store without shards reads as an empty table of the arrivals' columns.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ._files import read_file, write_file
from ._store import new_folder

TARGET_BYTES = 128 << 20
FAN = 4
BASE_BYTES = 1 << 20
ARRIVALS = 4


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    size: int

    def tier(self) -> int:
        return max(0, math.floor(math.log(max(1, self.size) / BASE_BYTES, FAN)))


class Store:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, target_bytes: int = TARGET_BYTES):
        self.spark, self.folder, self.schema, self.target = spark, folder, schema, target_bytes

    # versions

    def versions(self) -> list[int]:
        system, base = fs.FileSystem.from_uri(f"{self.folder}/versions")
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, by default of the newest; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        return [Shard(**x) for x in json.loads(read_file(f"{self.folder}/versions/{version:08d}.json"))["shards"]] if version else []

    def commit(self, version: int, shards: list[Shard]) -> None:
        new = write_file(f"{self.folder}/versions", f".new-{uuid.uuid4().hex}", json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode())
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        old, path = (jvm.org.apache.hadoop.fs.Path(p) for p in (new, f"{self.folder}/versions/{version:08d}.json"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(old, path, how)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} is there already") from e
            raise

    # data

    def _write(self, rows: DataFrame) -> list[Shard]:
        """Writes rows as new shards: the files that have rows."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        written = self.spark.read.schema(self.schema).parquet(path)
        files = written.groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n")).collect()
        return sorted((Shard(r.file_path, r.n, r.file_size) for r in files), key=lambda s: s.path)

    def append(self, rows: DataFrame) -> int:
        """Commits rows as small shards of their own; the new version."""
        version = max(self.versions(), default=0)
        before = self.shards(version)
        self.commit(version + 1, before + self._write(rows))
        return version + 1

    def compact(self) -> int:
        """Merges until no tier below the target has FAN shards (or merging makes no fewer of them); the newest version."""
        while True:
            version = max(self.versions(), default=0)
            shards, tiers = self.shards(version), {}
            for s in shards:
                if s.size < self.target / 2:
                    tiers.setdefault(s.tier(), []).append(s)
            merge = [t for t in tiers.values() if len(t) >= FAN]
            if not merge:
                return version
            new = self._write(self._packed(merge))
            old = {s.path for t in merge for s in t}
            if len(new) * 2 > len(old):
                return version
            self.commit(version + 1, [s for s in shards if s.path not in old] + new)

    def _packed(self, tiers: list[list[Shard]]) -> DataFrame:
        """Rows of the shards, each tier read in tasks of whole shards of about the target size in sum."""
        out = None
        for t in tiers:
            rows = self.spark.read.schema(self.schema).parquet(*(s.path for s in t)).coalesce(max(1, round(sum(s.size for s in t) / self.target)))
            out = rows if out is None else out.unionByName(rows)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with shard_file, shard_bytes and shard_version (which replace columns of these names)."""
        version = max(self.versions(), default=0) if version is None else version
        shards = self.shards(version)
        rows = self.spark.read.schema(self.schema).parquet(*(s.path for s in shards)) if shards else self.spark.createDataFrame([], self.schema)
        if not shards:
            return rows.withColumns({"shard_file": F.lit(""), "shard_bytes": F.lit(0).cast("long"), "shard_version": F.lit(version)})
        return rows.withColumns({"shard_file": F.col("_metadata.file_name"), "shard_bytes": F.col("_metadata.file_size"), "shard_version": F.lit(version)})

    def vacuum(self, keep: int = 1) -> int:
        """Removes shards that none of the newest `keep` versions names, and older manifests; how many shards went."""
        versions = self.versions()
        old, kept = versions[: -keep or None], versions[-keep:]
        named = {s.path for v in kept for s in self.shards(v)}
        gone = {s.path for v in old for s in self.shards(v)} - named
        for path in sorted(gone) + [f"{self.folder}/versions/{v:08d}.json" for v in old]:
            system, base = fs.FileSystem.from_uri(path)
            system.delete_file(base)
        return len(gone)


def sharded(docs: DataFrame, id_col: str = "doc_id", arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES, folder: str | None = None) -> DataFrame:
    """docs through a store: appended as `arrivals` arrivals (by a hash of the id), compacted after each, and read back from the newest version."""
    spark = docs.sparkSession
    store = Store(spark, folder or new_folder(spark, "shards"), docs.schema, target_bytes)
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64(id_col), F.lit(arrivals)) == k))
        store.compact()
        store.vacuum()
    return store.read()
