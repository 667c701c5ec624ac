"""Calls to models as jobs that can be taken up again: a Python data source whose writer makes the calls.

Jobs are dealt by endpoint: each endpoint has a rate and so many slots, a slot is a partition of its own, and a token bucket
in it gives its share of the rate, so that all tasks together keep to an endpoint's limit. A writer puts away what it has
finished every few calls, in a folder of its run and partition; the task that takes over from a lost executor reads that
folder and makes only the calls still open. Commit messages carry each partition's counts and files, and the driver writes
them as the report of the run. A run that fails as a whole leaves its replies too: the next one leaves them out by an anti-join.

Defined cases: what a call raises becomes the job's error and stops nothing; failed jobs are open again in the next run. A job without
a key is no job; of jobs with one key (rows may differ) one is called. A call whose reply was not yet put away when its executor was
lost is made again. Endpoints without a limit of their own share the default one, each by itself, in one partition.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

JOB = "job string, endpoint string, slot int, payload string"
REPLY = "job string, endpoint string, text string, error string, cost_usd double, wall_s double, input_tokens long, output_tokens long"
LOG = f"{REPLY}, run int, part int"


@dataclass(frozen=True)
class Limit:
    """Calls a second, dealt to so many slots."""

    rate: float
    slots: int = 1


DEFAULT = Limit(1.0)


class Bucket:
    """One token at first, ``rate`` more a second, never more than ``burst``."""

    def __init__(self, rate: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.seen = 1.0, clock()

    def take(self) -> None:
        self._fill()
        while self.tokens < 1.0 - 1e-9:
            self.sleep((1.0 - self.tokens) / self.rate)
            self._fill()
        self.tokens -= 1.0

    def _fill(self) -> None:
        now = self.clock()
        self.tokens, self.seen = min(self.burst, self.tokens + (now - self.seen) * self.rate), now


@dataclass
class Done(WriterCommitMessage):
    """What one partition did: jobs called, of these failed, jobs found done by an earlier attempt, files written."""

    partition: int
    called: int
    failed: int
    found: int
    files: list[str]


def answered(call: Callable[[str], dict], job: str, endpoint: str, payload: str | None) -> dict:
    """A reply row; never raises but for what ends the process."""
    start = time.monotonic()
    try:
        said = call(payload)
    except Exception as e:  # noqa: BLE001  a failed call is a row
        said = {"error": f"{type(e).__name__}: {e}"}
    row = {c.split()[0]: said.get(c.split()[0]) for c in REPLY.split(", ")}
    if row["wall_s"] is None:
        row["wall_s"] = time.monotonic() - start
    if not row["text"] and not row["error"]:
        row["error"] = "empty response"
    return row | {"job": job, "endpoint": endpoint}


def job_sink(calls: Callable[[str, str | None], dict], limits: dict[str, Limit], default: Limit = DEFAULT, every: int = 20) -> type[DataSource]:
    """A sink ``model_jobs`` that makes ``calls(endpoint, payload)`` and puts replies away ``every`` so many."""

    class Writer(DataSourceWriter):
        def __init__(self, options: dict):
            self.folder, self.run = options["path"].rstrip("/"), int(options["run"])

        def write(self, iterator: Iterator) -> Done:
            import pyarrow as pa
            import pyarrow.parquet as pq
            from pyarrow import fs

            kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
            schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in REPLY.split(", "))])
            number = TaskContext.get().partitionId()
            files, root = _filesystem(fs, self.folder)
            here = f"{root}/run={self.run}/part={number}"
            files.create_dir(here, recursive=True)
            before = [f.path for f in files.get_file_info(fs.FileSelector(here)) if f.base_name.endswith(".parquet")]
            done = {j for p in before for j in pq.read_table(p, columns=["job"], filesystem=files)["job"].to_pylist()}
            buckets: dict[tuple, Bucket] = {}
            out = Done(number, 0, 0, len(done), before)
            held: list[dict] = []

            def put_away() -> None:
                name = f"{uuid.uuid4().hex}.parquet"
                pq.write_table(pa.Table.from_pylist(held, schema), f"{here}/.{name}", filesystem=files)
                files.move(f"{here}/.{name}", f"{here}/{name}")
                out.files.append(f"{here}/{name}")
                held.clear()

            for row in iterator:
                if row.job in done:
                    continue
                done.add(row.job)
                if (row.endpoint, row.slot) not in buckets:
                    limit = limits.get(row.endpoint, default)
                    buckets[row.endpoint, row.slot] = Bucket(limit.rate / limit.slots)
                buckets[row.endpoint, row.slot].take()
                held.append(answered(lambda p: calls(row.endpoint, p), row.job, row.endpoint, row.payload))  # noqa: B023  called at once
                out.called += 1
                out.failed += held[-1]["error"] is not None
                if len(held) >= every:
                    put_away()
            if held:
                put_away()
            return out

        def commit(self, messages: list) -> None:
            self._report("finished", messages)

        def abort(self, messages: list) -> None:
            """Replies that were put away stand; the next run does the rest."""
            self._report("stopped", messages)

        def _report(self, state: str, messages: list) -> None:
            from pyarrow import fs

            files, root = _filesystem(fs, self.folder)
            files.create_dir(f"{root}/_runs", recursive=True)
            parts = [vars(m) for m in messages if m is not None]
            with files.open_output_stream(f"{root}/_runs/{self.run}.json") as f:
                f.write(json.dumps({"run": self.run, "state": state, "parts": parts}).encode())

    class ModelJobs(DataSource):
        @classmethod
        def name(cls) -> str:
            return "model_jobs"

        def schema(self) -> str:
            return JOB

        def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
            return Writer(dict(self.options))

    return ModelJobs


def _filesystem(fs, folder: str) -> tuple:  # noqa: ANN001
    return fs.FileSystem.from_uri(folder.replace("file:///", "/", 1) if folder.startswith("file:///") else folder)


def log(spark: SparkSession, folder: str) -> DataFrame:
    """All replies of all runs; nothing before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(folder)


def replies(found: DataFrame) -> DataFrame:
    """One reply a job: the first good one, else the latest failure."""
    good = F.col("error").isNull()
    rest = F.struct(*(c for c in found.columns if c != "job"))
    order = F.struct(good.cast("int").alias("good"), F.when(good, -F.col("run")).otherwise(F.col("run")).alias("run"), F.hash("part", "text").alias("tie"))
    return found.groupBy("job").agg(F.max_by(rest, order).alias("r")).select("job", "r.*")


def open_jobs(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Jobs that no run has a good reply of."""
    return jobs.filter(F.col("job").isNotNull()).join(found.filter(F.col("error").isNull()).select("job"), "job", "left_anti")


def _dealt(jobs: DataFrame, limits: dict[str, Limit]) -> DataFrame:
    """job, endpoint, slot, payload, a partition for each slot of each endpoint with a limit and one for the others."""
    slot: Column = F.lit(0)
    at, number = 1, F.lit(0)
    for name, limit in sorted(limits.items()):
        own = F.pmod(F.xxhash64("job"), F.lit(limit.slots)).cast("int")
        slot = F.when(F.col("endpoint") == name, own).otherwise(slot)
        number = F.when(F.col("endpoint") == name, own + at).otherwise(number)
        at += limit.slots
    once = jobs.groupBy("job").agg(F.min(F.struct("endpoint", "payload")).alias("j")).select("job", "j.*")
    return once.select("job", "endpoint", slot.alias("slot"), "payload", number.alias("number")).repartitionById(at, "number").drop("number")


def run_jobs(jobs: DataFrame, folder: str, calls: Callable[[str, str | None], dict], limits: dict[str, Limit], default: Limit = DEFAULT, every: int = 20) -> DataFrame:
    """Makes the calls that are open of ``jobs`` (job, endpoint, payload) and gives one reply a job of all runs in ``folder``.

    ``folder`` must be one that all machines see.
    """
    spark = jobs.sparkSession
    before = log(spark, folder)
    run = before.agg(F.max("run")).first()[0]
    spark.dataSource.register(job_sink(calls, limits, default, every))
    _dealt(open_jobs(jobs, before), limits).write.format("model_jobs").mode("append").option("path", folder).option("run", 0 if run is None else run + 1).save()
    return replies(log(spark, folder))
