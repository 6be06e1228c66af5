"""A maintenance cycle over several dependent state tables, once for each micro-batch.

A cycle is a row of steps. Each takes the batch, the tables as the steps before have left them and the moment, and gives new contents
for the tables it changes, in the pure style of operators.transitions. A step that fails leaves its tables as they were, is told
in the cycle's record, and the steps after it go on. Each batch counts once: what a cycle has written lies below its batch id, and
its record, put in place last by a rename, says which folders the tables are now. A batch whose record is there is done; one
that broke off before is run anew from the record of the batch before it.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete, exists

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Step:
    """run(batch, tables, moment) gives new contents of some of the tables."""

    name: str
    run: Callable[[DataFrame, Tables, Column], Tables]


class Cycle:
    """State tables (schemas by name) in a folder, and the steps that change them. The moment is the latest `ts` of any batch so far."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], steps: list[Step], ts: str = "ts"):
        self.spark, self.folder, self.schemas, self.steps, self.ts = spark, folder.rstrip("/"), schemas, steps, ts

    def _record(self, batch_id: int) -> str:
        return f"{self.folder}/records/{batch_id:012d}.json"

    def record(self, batch_id: int) -> dict | None:
        """What is known of a batch: moment, folder of each table, outcome of each step."""
        path = self._record(batch_id)
        if batch_id < 0:
            return {"moment": None, "tables": {}, "steps": []}
        if not exists(self.spark, path):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def _put(self, batch_id: int, record: dict) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        begun, done = path(f"{self.folder}/begun/{batch_id:012d}.json"), path(self._record(batch_id))
        out = fs.create(begun, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        fs.mkdirs(done.getParent())
        if not fs.rename(begun, done):
            raise RuntimeError(f"the record of batch {batch_id} could not be put in place")

    def tables(self, record: dict) -> Tables:
        return {name: self.spark.read.schema(kind).parquet(record["tables"][name]) if name in record["tables"] else self.spark.createDataFrame([], kind) for name, kind in self.schemas.items()}

    def run(self, batch: DataFrame, batch_id: int) -> dict:
        """The record of the batch, which is processed unless it was before."""
        done = self.record(batch_id)
        if done is not None:
            return done
        before = self.record(batch_id - 1)
        if before is None:
            raise RuntimeError(f"batch {batch_id - 1} has no record")
        batch = batch.persist()
        try:
            latest = batch.agg(F.max(self.ts).cast("string")).first()[0]
            at = max((m for m in (before["moment"], latest) if m is not None), default=None)
            now = {"moment": at, "tables": dict(before["tables"]), "steps": []}
            for number, step in enumerate(self.steps):
                paths = {}
                try:
                    for name, rows in step.run(batch, self.tables(now), moment(at)).items():
                        paths[name] = f"{self.folder}/tables/{batch_id:012d}/{number}-{name}"
                        rows.select(*self.spark.createDataFrame([], self.schemas[name]).columns).write.mode("overwrite").parquet(paths[name])
                except Exception as failure:  # noqa: BLE001  a step's failure is its own
                    for path in paths.values():
                        delete(self.spark, path)
                    now["steps"].append({"name": step.name, "outcome": "failed", "why": str(failure).splitlines()[0][:200] if str(failure) else type(failure).__name__})
                else:
                    now["tables"] |= paths
                    now["steps"].append({"name": step.name, "outcome": "done", "why": None})
        finally:
            batch.unpersist()
        self._put(batch_id, now)
        self._forget(batch_id, now)
        return now

    def _forget(self, batch_id: int, now: dict) -> None:
        """Folders that neither this batch's record nor the one before it names are deleted."""
        earlier, last = self.record(batch_id - 2), self.record(batch_id - 1)
        if earlier and last:
            for path in set(earlier["tables"].values()) - set(last["tables"].values()) - set(now["tables"].values()):
                delete(self.spark, path)

    def start(self, events: DataFrame):
        """The streaming query that runs a cycle for each micro-batch of events until all that there is has been taken."""
        write = events.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True)
        return write.foreachBatch(lambda batch, batch_id: self.run(batch, batch_id) and None).start()


def moment(text: str | None) -> Column:
    """A moment of a record as a timestamp."""
    return F.lit(datetime.datetime.fromisoformat(text) if text else None).cast("timestamp_ntz")
