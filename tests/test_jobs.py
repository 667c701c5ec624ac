import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import jobs

FAST = {"a": jobs.Limit(1e6, 3), "b": jobs.Limit(1e6, 1)}


def asked(spark, n):
    return spark.range(n).select(F.concat(F.lit("j"), "id").alias("job"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("endpoint"), F.col("id").cast("string").alias("payload"))


def test_bucket_gives_its_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    b = jobs.Bucket(4.0, clock=lambda: now[0], sleep=sleep)
    for _ in range(9):
        b.take()
    assert now[0] == pytest.approx(2.0) and len(slept) == 8
    now[0] += 100  # what is saved up is one token at most
    b.take()
    b.take()
    assert now[0] == pytest.approx(102.25)


def test_a_slot_is_a_partition(spark):
    dealt = jobs._dealt(asked(spark, 300), FAST).withColumn("p", F.spark_partition_id())
    places = {tuple(r) for r in dealt.select("endpoint", "slot", "p").distinct().collect()}
    assert len(places) == 5 and len({p for _, _, p in places}) == 5


def test_lost_worker_repeats_open_jobs_only(spark, tmp_path):
    """A call ends its process in the first run; the second makes what is open, and no call is made twice but those not put away."""
    made, log, died = tmp_path / "made", str(tmp_path / "log"), tmp_path / "died"
    made.mkdir()

    def call(endpoint, payload):
        if payload == "90" and not died.exists():
            died.touch()
            os._exit(1)
        with open(made / f"{os.getpid()}", "a") as f:
            f.write(payload + "\n")
        return {"text": f"{endpoint}{payload}", "output_tokens": 1}

    with pytest.raises(Exception):
        jobs.run_jobs(asked(spark, 120), log, call, FAST, jobs.Limit(1e6), every=1)
    kept = jobs.log(spark, log).count()
    assert 0 < kept < 120
    got = jobs.run_jobs(asked(spark, 120), log, call, FAST, jobs.Limit(1e6), every=1)
    assert got.count() == 120 and got.filter("error IS NULL").count() == 120
    calls = Counter(x for f in made.iterdir() for x in f.read_text().split())
    assert len(calls) == 120 and sum(calls.values()) - 120 <= 5  # at most one call a partition was not yet put away
    report = json.loads((tmp_path / "log" / "_runs" / "1.json").read_text())
    assert report["state"] == "finished" and sum(p["called"] for p in report["parts"]) == 120 - kept
    assert sorted(x for p in report["parts"] for x in p["files"]) == sorted(str(p) for p in (tmp_path / "log" / "run=1").rglob("[!.]*.parquet"))


def test_next_attempt_finds_what_the_last_put_away(spark, tmp_path):
    """The same partition of the same run again, as after a lost executor."""
    log = str(tmp_path / "log")
    for calls, want in (({"text": "one"}, (30, 0)), ({"text": "two"}, (20, 30))):
        spark.dataSource.register(jobs.job_sink(lambda e, p, c=calls: c, FAST, jobs.Limit(1e6), 7))
        n = sum(want)
        asked(spark, n).withColumn("slot", F.lit(0)).select("job", "endpoint", "slot", "payload").coalesce(1).write.format("model_jobs").mode("append").option("path", log).option("run", 4).save()
        part = json.loads((tmp_path / "log" / "_runs" / "4.json").read_text())["parts"][0]
        assert (part["called"], part["found"]) == want
    assert Counter(r.text for r in jobs.log(spark, log).collect()) == {"one": 30, "two": 20}


def test_failures_nulls_and_repeated_keys(spark, tmp_path):
    rows = [("x", "a", "1"), ("x", "a", "1"), ("x", "b", "0"), (None, "a", "1"), ("y", None, None), ("z", "a", "")]
    some = spark.createDataFrame(rows, "job string, endpoint string, payload string")
    down = lambda e, p: {"text": p} if e else {}[e]
    got = {r.job: (r.endpoint, r.text, r.error, r.run) for r in jobs.run_jobs(some, str(tmp_path / "l"), down, FAST, jobs.Limit(1e6)).collect()}
    assert got == {"x": ("a", "1", None, 0), "y": (None, None, "KeyError: None", 0), "z": ("a", "", "empty response", 0)}
    up = lambda e, p: {"text": "up"}
    got = {r.job: (r.text, r.run) for r in jobs.run_jobs(some, str(tmp_path / "l"), up, FAST, jobs.Limit(1e6)).collect()}
    assert got == {"x": ("1", 0), "y": ("up", 1), "z": ("up", 1)}
    assert jobs.run_jobs(some.limit(0), str(tmp_path / "none"), up, FAST).isEmpty()
