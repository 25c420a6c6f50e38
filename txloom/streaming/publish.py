"""Publishing that lasts: batches with a manifest and tries of their own, and totals that cost no job."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Seconds before each try: dead letters and messages, and announcements.
TRIES, ANNOUNCEMENTS = (0.0, 0.5, 1.0, 2.0), (0.0, 1.0, 2.0, 4.0, 8.0)
LONGEST = 10.0


class Unpublished(RuntimeError):
    """No try succeeded: the stream must end, so that the batch is replayed."""


def lasting(write: Callable[[], None], waits: Sequence[float] = TRIES, sleep: Callable[[float], None] = time.sleep) -> int:
    """Call write until it succeeds, after the waits given; the number of tries it took. Unpublished after the last."""
    problem: Exception | None = None
    for n, wait in enumerate(waits, 1):
        if wait:
            sleep(min(wait, LONGEST))
        try:
            write()
            return n
        except Exception as e:  # whatever the sink raises: it is tried again
            problem = e
    raise Unpublished(f"{len(waits)} tries failed: {problem}") from problem


class Log:
    """A topic whose batches appear whole: each try writes a folder of its own, and the batch's manifest names the one that
    counts. A reader sees batches with a manifest only; a batch that has one is not written again."""

    def __init__(self, spark: SparkSession, path: str, write: Callable[[DataFrame, str], None] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.write = write or (lambda df, folder: df.write.parquet(folder))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> dict[int, str]:
        """The folder of each published batch."""
        fs, p = self._fs(f"{self.path}/_manifest")
        out = {}
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = s.getPath().getName()
            if name.endswith(".json"):
                out[int(name.removesuffix(".json"))] = json.loads(self._text(s.getPath()))["folder"]
        return dict(sorted(out.items()))

    def _text(self, p) -> str:
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        source = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def publish(self, df: DataFrame, batch: int, waits: Sequence[float] = TRIES) -> int:
        """Publish a batch; the number of tries (0 if it was published before)."""
        if batch in self.batches():
            return 0
        folder = ""

        def once() -> None:
            nonlocal folder
            folder = f"data/batch={batch}-{uuid.uuid4().hex}"
            self.write(df, f"{self.path}/{folder}")

        tries = lasting(once, waits)
        # a manifest appears by a rename, so whole or not at all
        fs, draft = self._fs(f"{self.path}/_manifest/.{batch}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"folder": folder, "tries": tries}).encode()))
        out.close()
        fs.rename(draft, self._fs(f"{self.path}/_manifest/{batch}.json")[1])
        return tries

    def read(self, schema: str) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in self.batches().values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


class Totals:
    """Running totals of a service, taken from the writes that happen anyway (DataFrame.observe): no job of their own."""

    def __init__(self, **kinds: Column):
        self.kinds, self.sums, self._lock = kinds, dict.fromkeys(kinds, 0), threading.Lock()

    def watched(self, df: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, int]:
        """Write df, and add up what was counted on the way; what this one write counted."""
        seen = Observation()
        write(df.observe(seen, *[F.count_if(c).alias(k) for k, c in self.kinds.items()]))
        return self.add({k: int(v or 0) for k, v in seen.get.items()})

    def add(self, counts: dict[str, int]) -> dict[str, int]:
        with self._lock:
            for k, v in counts.items():
                self.sums[k] = self.sums.get(k, 0) + v
        return counts
