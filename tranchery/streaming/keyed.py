"""Keyed tables that streams keep: each batch adds small files to the hash buckets it touches, readers merge them, and a
manifest per version lists the files that make it up.

A batch writes what it holds, not the table: its rows are reduced per key and written as one file per touched bucket.  A
bucket of more than ``max_deltas`` files is merged into one, in the batch that finds it so; the others stay as they
are.  The manifest is written beside its place and renamed over it once all files stand, so a version is there in whole
or not at all, running a batch again replaces its own version, and readers of older versions keep their files until
``prune`` takes these versions away.

``merge`` reduces rows of equal key to one and must give the same for any grouping of the rows (the last change of a
key, sums).  A manifest has at most buckets * (max_deltas + 1) entries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 16, max_deltas: int = 4):
        self.spark, self.path, self.schema, self.keys, self.merge = spark, path.rstrip("/"), schema, keys, merge
        self.buckets, self.max_deltas = buckets, max_deltas
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        """Ascending numbers of the complete versions."""
        folder = self._hadoop(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))

    def files(self, version: int | None = None) -> dict[int, list[dict]]:
        """bucket -> its files (path, bytes) in the last version, or the last up to ``version``."""
        have = [v for v in self.versions() if version is None or v <= version]
        if not have:
            return {}
        stream = self._fs.open(self._hadoop(f"{self.path}/manifests/v={have[-1]}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {int(b): files for b, files in json.loads(text)["buckets"].items()}

    def read(self, version: int | None = None) -> DataFrame:
        """One row per key as of a version; empty where there is none.  Buckets of one file need no merge."""
        buckets = self.files(version)
        done = [f for files in buckets.values() if len(files) == 1 for f in files]
        open_ = [f for files in buckets.values() if len(files) > 1 for f in files]
        parts = [self._rows(done)] if done or not open_ else []
        parts += [self.merge(self._rows(open_))] if open_ else []
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def prune(self, keep: int) -> int:
        """Take away all but the last ``keep`` versions and the files that only these used; the number of files gone."""
        versions = self.versions()
        used = {f["path"] for v in versions[-keep:] for files in self.files(v).values() for f in files}
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/manifests/v={v}.json"), False)
        gone = [f["path"] for f in self._listed(f"{self.path}/data") if f["path"] not in used]
        for p in gone:
            self._fs.delete(self._hadoop(p), False)
        return len(gone)

    # writing

    def add(self, rows: DataFrame, version: int) -> None:
        """The version that follows all those below ``version``: what they hold, and ``rows``."""
        buckets = self.files(version - 1)
        for b, files in self._written(self.merge(rows), version).items():
            buckets.setdefault(b, []).extend(files)
        crowded = [b for b, files in buckets.items() if len(files) > self.max_deltas]
        if crowded:
            whole = self.merge(self._rows([f for b in crowded for f in buckets[b]]))
            buckets |= self._written(whole, version)
        self._publish(version, buckets)

    def _rows(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f["path"] for f in files])

    def _written(self, rows: DataFrame, version: int) -> dict[int, list[dict]]:
        """Writes rows as one file per bucket, in a folder of this attempt."""
        folder = f"{self.path}/data/v={version}-{uuid.uuid4().hex[:12]}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        placed = rows.withColumn("bucket", bucket).repartitionById(self.buckets, F.col("bucket"))
        placed.write.partitionBy("bucket").parquet(folder)
        out: dict[int, list[dict]] = {}
        for f in self._listed(folder):
            out.setdefault(int(f["path"].rsplit("/bucket=", 1)[1].split("/")[0]), []).append(f)
        return out

    def _publish(self, version: int, buckets: dict[int, list[dict]]) -> None:
        text = json.dumps({"version": version, "buckets": buckets})
        draft = self._hadoop(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(text, "utf-8"))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(draft, self._hadoop(f"{self.path}/manifests/v={version}.json"), how)

    def _listed(self, folder: str) -> list[dict]:
        root, out = self._hadoop(folder), []
        if not self._fs.exists(root):
            return out
        walk = self._fs.listFiles(root, True)
        while walk.hasNext():
            s = walk.next()
            name = s.getPath().getName()
            if not name.startswith(("_", ".")):
                out.append({"path": s.getPath().toString(), "bytes": s.getLen()})
        return sorted(out, key=lambda f: f["path"])

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)
