"""Versions of records, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from ..streaming import keyed_state
from ..session import work_folder
from .registry import query
from .views import table

_STATES = """states AS (SELECT user_id AS stem, CAST(ts AS DATE) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM events GROUP BY ALL)"""
_VERSIONS = f"""{_STATES}, versions AS (SELECT stem, day, items, lag(day) OVER (PARTITION BY stem ORDER BY day) AS supersedes
  FROM (SELECT *, lag(items) OVER (PARTITION BY stem ORDER BY day) AS b FROM states) WHERE b IS NULL OR b <> items)"""
_CHANGES = f"""{_VERSIONS}, pairs AS (SELECT stem, day, string_split(items, ',') AS new, string_split(lag(items) OVER (PARTITION BY stem ORDER BY day), ',') AS old FROM versions),
changes AS (SELECT stem, day, array_to_string(list_sort([x FOR x IN new IF NOT list_contains(old, x)]), ',') AS added, array_to_string(list_sort([x FOR x IN old IF NOT list_contains(new, x)]), ',') AS removed FROM pairs WHERE old IS NOT NULL)"""


def _states(spark, sf):
    day = table(spark, sf, "events").select(F.col("user_id").alias("stem"), F.col("ts").cast("date").alias("day"), "event_type")
    grouped = day.groupBy("stem", "day").agg(F.sort_array(F.collect_set("event_type")).alias("types"))  # five types at most
    return grouped.withColumn("items", F.array_join("types", ",")).withColumn("content_sha256", F.sha2("items", 256))


def _versions(spark, sf):
    return history.changed_versions(_states(spark, sf), date="day")


@query(f"WITH {_VERSIONS} SELECT * FROM versions")
def content_versions(spark, sf):
    return _versions(spark, sf).select("stem", "day", "items", "supersedes")


@query(f"""WITH {_VERSIONS}, asked AS (SELECT DISTINCT user_id AS stem, DATE '2024-01-15' AS as_of FROM events)
SELECT a.stem, a.as_of, max(v.day) AS day, max_by(v.items, v.day) AS items FROM asked a LEFT JOIN versions v ON v.stem = a.stem AND v.day <= a.as_of GROUP BY ALL""")
def state_as_of(spark, sf):
    asked = table(spark, sf, "events").select(F.col("user_id").alias("stem")).distinct().withColumn("as_of", F.to_date(F.lit("2024-01-15")))
    return history.state_as_of(_versions(spark, sf).select("stem", "day", "items"), asked, date="day")


def _log(spark, sf):
    return history.list_changelog(_versions(spark, sf), "types", date="day")


@query(f"WITH {_CHANGES} SELECT * FROM changes")
def full_changelog(spark, sf):
    return _log(spark, sf).select("stem", "day", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(f"WITH {_CHANGES} SELECT s.*, coalesce(c.n, 0) AS n_changes, c.d AS last_change FROM (SELECT stem, min(day) AS first_seen, max(day) AS last_analysis FROM versions GROUP BY stem) s LEFT JOIN (SELECT stem, count(*) AS n, max(day) AS d FROM changes GROUP BY stem) c USING (stem)")
def first_last_seen(spark, sf):
    return history.changes_and_dates(_log(spark, sf), _versions(spark, sf), date="day")


_DAYS = """a AS (SELECT user_id AS stem, max_by(event_type, event_id) AS x, list_sort(list(DISTINCT event_type)) AS l FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY user_id),
b AS (SELECT user_id AS stem, max_by(event_type, event_id) AS x, list_sort(list(DISTINCT event_type)) AS l FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY user_id)"""


@query(f"""WITH {_DAYS} SELECT stem, CASE WHEN a.x IS DISTINCT FROM b.x THEN 'last' ELSE '' END AS changed,
array_to_string([t FOR t IN b.l IF NOT list_contains(a.l, t)], ',') AS added, array_to_string([t FOR t IN a.l IF NOT list_contains(b.l, t)], ',') AS removed FROM a JOIN b USING (stem)""")
def feature_diff(spark, sf):
    events = table(spark, sf, "events").withColumn("stem", F.col("user_id"))
    of = lambda d, n: d.groupBy("stem").agg(F.create_map(F.lit("last"), F.max_by("event_type", "event_id")).alias(f"m{n}"), F.collect_set("event_type").alias(f"l{n}"))
    both = of(events.filter("ts < TIMESTAMP_NTZ '2024-01-10'"), 0).join(of(events.filter("ts >= TIMESTAMP_NTZ '2024-01-20'"), 1), "stem")
    added, removed = history.list_difference(F.col("l0"), F.col("l1"))
    changed = history.map_difference(F.col("m0"), F.col("m1"))
    return both.select("stem", F.array_join(changed, ",").alias("changed"), F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"))


@query(f"""WITH {_CHANGES}, f AS (SELECT stem, count(*) AS n, max(day) AS d FROM changes WHERE stem % 3 <> 0 GROUP BY stem),
p AS (SELECT user_id AS stem, count(*) AS n, max(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 GROUP BY user_id),
k AS (SELECT user_id AS stem, count(*) AS n FROM events GROUP BY user_id)
SELECT coalesce(f.stem, p.stem) AS stem, coalesce(f.n, 0) AS feature_changes, coalesce(p.n, 0) AS price_changes, greatest(f.d, p.d) AS last_change FROM f FULL JOIN p ON f.stem = p.stem LEFT JOIN k ON k.stem = coalesce(f.stem, p.stem) WHERE f.stem IS NOT NULL OR p.n >= 1 OR k.n >= 2""")
def change_summary(spark, sf):
    events = table(spark, sf, "events").withColumn("stem", F.col("user_id"))
    count = lambda d, c: d.groupBy("stem").agg(F.count(F.lit(1)).alias("n_changes"), F.max(c).alias("last_change"))
    features = count(_log(spark, sf).filter("stem % 3 <> 0"), "day")
    prices = count(events.filter("event_type = 'purchase' AND user_id % 2 = 0").withColumn("day", F.col("ts").cast("date")), "day")
    return history.with_price_changes(features, prices, events.groupBy("stem").agg(F.count(F.lit(1)).alias("n_points")))


@query(f"""WITH {_STATES}, h AS (SELECT * FROM states WHERE day <= DATE '2024-01-20'), b AS (SELECT stem, max(day) AS day, max_by(items, day) AS items FROM states GROUP BY stem),
n AS (SELECT b.stem, max(h.day) AS newest, max_by(h.items, h.day) AS items FROM b JOIN h ON h.stem = b.stem AND h.day <= b.day GROUP BY b.stem)
SELECT b.stem, b.day, b.items, CASE WHEN n.newest IS DISTINCT FROM b.day THEN n.newest END AS supersedes, coalesce(n.newest = b.day, false) AS replaced FROM b LEFT JOIN n USING (stem) WHERE n.items IS NULL OR n.items <> b.items""")
def append_on_change(spark, sf):
    states = _states(spark, sf).select("stem", "day", "items", "content_sha256")
    batch = states.groupBy("stem").agg(F.max("day").alias("day"), F.max_by("items", "day").alias("items"), F.max_by("content_sha256", "day").alias("content_sha256"))
    return history.append_changed(states.filter("day <= DATE '2024-01-20'"), batch, date="day").drop("content_sha256")


@query("SELECT DISTINCT user_id AS stem FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00')")
def backfill_missing(spark, sf):
    events = table(spark, sf, "events").withColumn("stem", F.col("user_id"))
    early = events.filter("ts < TIMESTAMP_NTZ '2024-01-01 06:00:00'")
    return history.without_history(events.select("stem").distinct(), early)


@query("SELECT user_id AS stem, CASE WHEN d <= 30 THEN 'recent' WHEN d > 60 THEN 'stale' ELSE 'current' END AS state FROM (SELECT user_id, date_diff('day', CAST(min(ts) AS DATE), DATE '2024-02-20') AS d FROM events GROUP BY user_id)")
def recency(spark, sf):
    first = table(spark, sf, "events").groupBy(F.col("user_id").alias("stem")).agg(F.min("ts").cast("date").alias("d"))
    return first.select("stem", history.recency(F.col("d"), F.to_date(F.lit("2024-02-20"))).alias("state"))


@query(f"WITH {_VERSIONS} SELECT * FROM versions")
def append_on_change_stream(spark, sf):
    """The versions again, from a stream through one checkpoint: states in order, some of them wrong; then late ones and right ones
    for the same days; then much of both once more."""
    at = work_folder(spark)
    states = _states(spark, sf).select("stem", "day", "items")
    dealt = states.withColumn("n", F.pmod(F.xxhash64("stem", "day"), F.lit(10)))
    seen = lambda d: F.lit(f"2024-03-{d:02}").cast("timestamp").alias("seen")
    wrong = F.when(F.col("n") == 3, "?").otherwise(F.col("items")).alias("items")
    first, second = dealt.filter("n > 1").select("stem", "day", wrong, seen(1)), dealt.filter("n < 2 OR n = 3").select("stem", "day", "items", seen(2))
    for batch in (first, second, first.unionByName(second).filter("stem % 2 = 0")):
        batch.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(batch.schema).parquet(f"{at}/in")
        keyed_state.drained(keyed_state.versions(stream), f"{at}/out", f"{at}/checkpoint")
    return keyed_state.current_versions(spark.read.schema(keyed_state.VERSIONS).parquet(f"{at}/out"))
