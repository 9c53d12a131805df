"""The newest row per key as a table whose reading cost is bounded.

A table is a folder of immutable parts and a log. A merge writes the batch's newest rows per key as one more part and then commits
a manifest that names the parts in force, newest last; a manifest is written aside and renamed, so it is there whole or not
at all. When there are more than ``most_parts`` parts, the merge writes one compacted part instead. A crash between the two
steps leaves a part that no manifest names: the batch runs again and writes its own. A batch number that the log has seen
changes nothing. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


class CurrentTable:
    """``key``: one row each; ``order``: columns by which a row is newer (then the later batch wins)."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], most_parts: int = 8):
        self.spark, self.path, self.key, self.order, self.most_parts = spark, path.rstrip("/"), key, order, most_parts

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def manifest(self) -> dict:
        """The last committed version: version, batch_id, parts."""
        files, log = self._files(f"{self.path}/log")
        if not files.exists(log):
            return {"version": 0, "batch_id": -1, "parts": []}
        names = [s.getPath().getName() for s in files.listStatus(log)]
        last = max((n for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=None)
        if last is None:
            return {"version": 0, "batch_id": -1, "parts": []}
        stream = files.open(self._files(f"{self.path}/log/{last}")[1])
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        files, aside = self._files(f"{self.path}/log/.{uuid.uuid4().hex}.tmp")
        out = files.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._files(f"{self.path}/log/{manifest['version']:012d}.json")[1]
        if files.exists(final) or not files.rename(aside, final):
            files.delete(aside, False)
            raise RuntimeError(f"version {manifest['version']} has another writer")

    def _newest(self, rows: DataFrame, *tie: str) -> DataFrame:
        columns = [c for c in rows.columns if c not in (self.key, *tie)]
        newest = F.max_by(F.struct(*columns), F.struct(*self.order, *tie)).alias("r")
        return rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(newest).select(self.key, *[F.col(f"r.{c}").alias(c) for c in columns])

    def _read(self, parts: list[str]) -> DataFrame:
        one = [self.spark.read.parquet(f"{self.path}/{p}").withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
        rows = one[0]
        for more in one[1:]:
            rows = rows.unionByName(more)
        return self._newest(rows, "_part").drop("_part") if len(parts) > 1 else rows.drop("_part")

    def read(self) -> DataFrame:
        """One row per key; opens the parts of the last version alone. An error before the first merge."""
        parts = self.manifest()["parts"]
        if not parts:
            raise ValueError(f"nothing has been merged into {self.path}")
        return self._read(parts)

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Take in the rows of a batch; False if it was taken in before. Rows without a key are left out."""
        now = self.manifest()
        if batch_id <= now["batch_id"]:
            return False
        part = f"part-{now['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        newest = self._newest(batch)
        parts = [*now["parts"], part]
        if len(now["parts"]) >= self.most_parts:
            older = self._read(now["parts"]).withColumn("_part", F.lit(0))
            newest, parts = self._newest(older.unionByName(newest.withColumn("_part", F.lit(1))), "_part").drop("_part"), [part]
        newest.write.parquet(f"{self.path}/{part}")
        self._commit({"version": now["version"] + 1, "batch_id": batch_id, "parts": parts})
        return True

    def vacuum(self) -> int:
        """Remove the parts that the last version does not name; readers of older versions must be done. Their number."""
        files, root = self._files(self.path)
        keep = set(self.manifest()["parts"])
        old = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("part-") and s.getPath().getName() not in keep]
        for path in old:
            files.delete(path, True)
        return len(old)


def stream_current(rows: DataFrame, table: CurrentTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Merge every batch of a stream; a batch that is run again after a failure changes nothing."""
    return (
        rows.writeStream.foreachBatch(lambda batch, batch_id: table.merge(batch, batch_id) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
