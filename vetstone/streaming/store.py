"""The findings store: a directory of Parquet states, flipped atomically, and an append-only event log.

`foreach_batch` makes the same upsert the sink of a structured stream of scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetstone.operators.state import put_suppressions, upsert

STATE = "finding_id string, status string, risk_score double, finding_json string, first_seen timestamp, last_seen timestamp"
SUPPRESSION = "finding_id string, reason string, expires string"
#: The layout's version, and what brings a store of the version before to it.
VERSION = 1
MIGRATIONS = {1: lambda store: None}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        """Opens a store, or makes it; one that a newer engine wrote is refused, an older one is brought forward."""
        self.spark, self.root = spark, root.rstrip("/")
        fs, p = self._fs(f"{self.root}/version")
        found = max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0
        if found > VERSION:
            raise ValueError(f"{root} has version {found}; this engine knows {VERSION}")
        for v in range(found + 1, VERSION + 1):
            MIGRATIONS[v](self)
            fs.mkdirs(self._fs(f"{self.root}/version/{v}")[1])

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _generations(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/state")
        if not fs.exists(p):
            return []
        done = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(x.getName()[1:]) for x in done if x.getName().startswith("g") and fs.exists(self._fs(f"{x}/_SUCCESS")[1]))

    def findings(self) -> DataFrame:
        """The current state: the last generation whose writing ended."""
        g = self._generations()
        return self.spark.read.schema(STATE).parquet(f"{self.root}/state/g{g[-1]}") if g else self.spark.createDataFrame([], STATE)

    def history(self, finding_id: str) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/events").where(F.col("finding_id") == finding_id).orderBy("at", "generation", "kind")

    def _batches(self) -> dict[int, int]:
        """Generation by batch of a stream."""
        fs, p = self._fs(f"{self.root}/batches")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return {int(b): int(g) for b, g in (x.split("-") for x in names)}

    def put(self, incoming: DataFrame, at, generation: int | None = None) -> dict[str, int]:
        """Upserts a scan's findings; gives how many events of each kind that made. A generation that is written again
        replaces what was written of it, from the state before."""
        done = self._generations()
        g = generation or (done or [0])[-1] + 1
        before = [x for x in done if x < g]
        old = self.spark.read.schema(STATE).parquet(f"{self.root}/state/g{before[-1]}") if before else self.spark.createDataFrame([], STATE)
        state, events = upsert(old, incoming, at)
        events.withColumn("generation", F.lit(g)).write.mode("overwrite").parquet(f"{self.root}/events/g{g}")
        state.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/state/g{g}")
        return {r.kind: r["count"] for r in self.spark.read.parquet(f"{self.root}/events/g{g}").groupBy("kind").count().collect()}

    def foreach_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For writeStream.foreachBatch: a batch is a scan; one that is replayed changes nothing. Of several rows of a
        finding the last in order of all columns holds."""
        known = self._batches()
        if known.get(batch_id, 0) in self._generations():
            return
        g = known.get(batch_id) or max([0, *self._generations(), *known.values()]) + 1
        fs, p = self._fs(f"{self.root}/batches/{batch_id}-{g}")
        fs.mkdirs(p)
        rest = [c for c in batch.columns if c != "finding_id"]
        self.put(batch.groupBy("finding_id").agg(F.max(F.struct(*rest)).alias("r")).select("finding_id", "r.*"), F.current_timestamp(), g)

    def save_baseline(self, name: str, findings: DataFrame) -> None:
        """Keeps the ids of a set of findings under a name, in the place of an earlier one."""
        findings.select("finding_id").distinct().write.mode("overwrite").parquet(f"{self.root}/baselines/name={name}")

    def baseline(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/baselines/name={name}").select("finding_id")

    def suppressions(self) -> DataFrame:
        fs, p = self._fs(f"{self.root}/suppressions")
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])] if fs.exists(p) else []
        if not done:
            return self.spark.createDataFrame([], SUPPRESSION)
        return self.spark.read.schema(SUPPRESSION).parquet(f"{self.root}/suppressions/g{max(done)}")

    def suppress(self, incoming: DataFrame) -> None:
        """Puts suppressions (finding_id, reason, expires), by id, as a new generation."""
        fs, p = self._fs(f"{self.root}/suppressions")
        g = max([0, *(int(s.getPath().getName()[1:]) for s in fs.listStatus(p))] if fs.exists(p) else [0]) + 1
        put_suppressions(self.suppressions(), incoming.select("finding_id", "reason", "expires")).write.mode("overwrite").parquet(f"{self.root}/suppressions/g{g}")
