"""A store of rows by key in a shared folder: batches named by commits, of which the first that holds a key counts.

Rows of a batch are Parquet in a folder of their own, parted by the first digits of the key. A commit is a small
numbered file that names a batch; it is made by a rename that fails if the number is taken, and the writer then
takes the next one. So writers never wait for each other, a batch whose writer died is named by no commit and
never read, and a key that two writers brought has the row of the earlier commit for every reader. Compaction
writes all rows of the commits so far as one batch, by a commit that stands for them.

As safe as the file system's rename: atomic on HDFS, checked then done on a local disk. Files that can't be read
any more count as lacking. Rows without a key are left out; of rows of one key in one batch one is kept.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of a hex key that name its folder: 16 of them, of files that are cut by size.
DIGITS = 1
COMMITS = "commit bigint, batch string, upto bigint"


class KeyedStore:
    def __init__(self, spark: SparkSession, root: str, key: str, columns: str) -> None:
        """key: a column of hex digests; columns: the schema of the others."""
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = f"`{key}` string, {columns}"
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._paths(self.root).getFileSystem(self._conf)

    def _exists(self, place: str) -> bool:
        return self._fs.exists(self._paths(place))

    def commits(self) -> list[tuple[int, str, int | None]]:
        """(commit, batch, upto) in order; upto is set where the batch stands for all commits up to that one."""
        if not self._exists(f"{self.root}/commits"):
            return []
        rows = self.spark.read.schema(COMMITS).json(f"{self.root}/commits").collect()  # a small row for each batch since the last cleaning
        return sorted((r.commit, r.batch, r.upto) for r in rows)

    def live(self) -> list[tuple[int, str]]:
        """(place, batch) of the batches that readers see: the furthest compaction, and the commits after those it stands for."""
        found = self.commits()
        base = max(((upto, batch) for _, batch, upto in found if upto is not None), default=None)
        after = [(k, batch) for k, batch, upto in found if upto is None and (base is None or k > base[0])]
        return ([base] if base else []) + after

    def commit(self, batch: str, upto: int | None = None) -> int:
        """The number under which the batch is now seen."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        modes = self.spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        modes[0] = getattr(fs, "Options$Rename").NONE
        self._fs.mkdirs(self._paths(f"{self.root}/commits"))
        number = max((k for k, *_ in self.commits()), default=0) + 1
        while True:
            draft = self._paths(f"{self.root}/commits/.{uuid.uuid4().hex}")
            out = self._fs.create(draft, False)
            out.write(bytearray(json.dumps({"commit": number, "batch": batch, "upto": upto}).encode()))
            out.close()
            place = self._paths(f"{self.root}/commits/{number:020d}.json")
            try:
                context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(place), modes)
                return number
            except Exception:
                self._fs.delete(draft, False)
                if not self._fs.exists(place):
                    raise
                number += 1

    def write(self, rows: DataFrame) -> str:
        """Writes a batch, which no reader sees before it is committed, and returns its name."""
        batch = uuid.uuid4().hex
        kept = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).withColumn("prefix", F.substring(self.key, 1, DIGITS))
        kept.hint("rebalance", F.col("prefix")).write.partitionBy("prefix").parquet(f"{self.root}/data/batch={batch}")
        return batch

    def append(self, rows: DataFrame) -> int:
        return self.commit(self.write(rows))

    def _scan(self, batches: list[str], prefixes: list[str] | None) -> DataFrame:
        """All rows of batches, of the given prefixes of keys only: other folders aren't read."""
        places = [p for p in (f"{self.root}/data/batch={b}" for b in batches) if self._exists(p)]
        reader = self.spark.read.schema(f"{self.schema}, batch string, prefix string").option("basePath", f"{self.root}/data").option("ignoreCorruptFiles", True)
        rows = reader.parquet(*places) if places else self.spark.createDataFrame([], f"{self.schema}, batch string, prefix string")
        return rows if prefixes is None else rows.where(F.col("prefix").isin(*prefixes))

    def read(self, prefixes: list[str] | None = None) -> DataFrame:
        """One row a key, of the first commit that holds it."""
        live = self.live()
        rows = self._scan([b for _, b in live], prefixes)
        names = [c for c in rows.columns if c not in ("batch", "prefix")]
        if len(live) < 2:
            return rows.select(*names)
        places = F.broadcast(self.spark.createDataFrame(live, "place bigint, batch string"))  # a row a batch
        first = F.min_by(F.struct(*names), "place").alias("x")
        return rows.join(places, "batch").groupBy(self.key).agg(first).select("x.*")

    def prefixes_of(self, keys: DataFrame) -> list[str]:
        """The prefixes that occur among keys, 16 at most."""
        return sorted(r[0] for r in keys.select(F.substring(self.key, 1, DIGITS)).distinct().collect() if r[0] is not None)

    def misses(self, wanted: DataFrame) -> DataFrame:
        """One row of wanted for each key that the store lacks; only the folders of the prefixes that occur are read, and only keys."""
        held = self._scan([b for _, b in self.live()], self.prefixes_of(wanted)).select(self.key)
        return wanted.dropDuplicates([self.key]).join(held, self.key, "left_anti")

    def found(self, wanted: DataFrame) -> DataFrame:
        """wanted with the stored columns of its keys; rows whose key the store lacks are left out."""
        return wanted.join(self.read(self.prefixes_of(wanted)), self.key)

    def compact(self) -> int | None:
        """Writes what readers see as one batch; writers and readers meanwhile go on. None where one batch is all there is."""
        found, live = self.commits(), self.live()
        if len(live) < 2:
            return None
        upto = max(k for k, *_ in found)
        return self.commit(self.write(self.read()), upto)

    def clean(self, older_than_s: float = 86_400.0) -> int:
        """Deletes batches that no reader sees and that are older than the longest read or write takes, and commits that a compaction stands for."""
        live = self.live()
        seen, base = {b for _, b in live}, next((k for k, b, upto in self.commits() if upto is not None and b == live[0][1]), None) if live else None
        gone, limit = 0, (time.time() - older_than_s) * 1000
        for status in self._fs.listStatus(self._paths(f"{self.root}/data")) if self._exists(f"{self.root}/data") else []:
            if status.getPath().getName().removeprefix("batch=") not in seen and status.getModificationTime() <= limit:
                gone += bool(self._fs.delete(status.getPath(), True))
        if base is not None:
            upto = live[0][0]
            for k, _, to in self.commits():
                place = self._paths(f"{self.root}/commits/{k:020d}.json")
                if k != base and (k <= upto or to is not None) and self._fs.getFileStatus(place).getModificationTime() <= limit:
                    self._fs.delete(place, False)
        return gone
