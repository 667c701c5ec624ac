"""Snapshots, prices over time, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, scores
from ..operators import dedup, ranking, series, snapshots
from .registry import query
from .views import BEFORE, MODULES, NEEDS, NEW, NOTE_SCORE, NOW, OLD, RATING_SCORE, SNAP, TARIFFS, market, snapshot, table, tariffs

_GRADED = f"""reps AS (SELECT stem, note, bewertung, price FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY price NULLS LAST, position) AS r FROM now) WHERE r = 1),
graded AS (SELECT t.*, r.price, CASE WHEN r.note IS NULL THEN 0.0::DOUBLE ELSE {NOTE_SCORE} END AS dim_note, CASE WHEN r.bewertung IS NULL THEN 0.5::DOUBLE ELSE {RATING_SCORE} END AS dim_bewertung
  FROM tariffs t LEFT JOIN reps r USING (stem)),
ranked AS (SELECT stem, price, dim_note, leistung_cov AS dim_leistung_cov, module_breadth AS dim_module_breadth, coverage_gen AS dim_coverage_gen, dim_bewertung,
  dim_note * 0.35::DOUBLE + leistung_cov * 0.22::DOUBLE + module_breadth * 0.20::DOUBLE + coverage_gen * 0.18::DOUBLE + dim_bewertung * 0.05::DOUBLE AS total FROM graded)"""
_RANKED = f"WITH {SNAP}, {NOW}, {TARIFFS}, {_GRADED}"


def _ranked(spark, sf):
    return ranking.rank(tariffs(spark, sf), snapshot(spark, sf))


@query(f"{_RANKED} SELECT *, CASE WHEN price > 0 THEN total / price END AS value FROM ranked")
def magic_rank(spark, sf):
    return ranking.best_first(_ranked(spark, sf))


@query(f"{_RANKED} SELECT stem, price, total, total / price AS value, (total / price) / max(total / price) OVER () AS relative_value FROM ranked WHERE price > 0")
def value_for_money(spark, sf):
    return ranking.relative_value(_ranked(spark, sf)).filter("value IS NOT NULL").select("stem", "price", "total", "value", "relative_value")


@query(f"""{_RANKED} SELECT stem, d.dimension, d.raw, d.weight, d.raw * d.weight AS contribution FROM ranked, unnest([
  {{'dimension': 'note', 'raw': dim_note, 'weight': 0.35::DOUBLE}}, {{'dimension': 'leistung_cov', 'raw': dim_leistung_cov, 'weight': 0.22::DOUBLE}},
  {{'dimension': 'module_breadth', 'raw': dim_module_breadth, 'weight': 0.20::DOUBLE}}, {{'dimension': 'coverage_gen', 'raw': dim_coverage_gen, 'weight': 0.18::DOUBLE}},
  {{'dimension': 'bewertung', 'raw': dim_bewertung, 'weight': 0.05::DOUBLE}}]) AS t(d)""")
def score_contributions(spark, sf):
    return ranking.contributions(_ranked(spark, sf))


_PRE = f"""pre AS (SELECT insurer, product, pre_score, position FROM (SELECT *, row_number() OVER (PARTITION BY insurer, product ORDER BY pre_score DESC, position) AS r
  FROM (SELECT *, 0.7::DOUBLE * {NOTE_SCORE} + 0.3::DOUBLE * {RATING_SCORE} AS pre_score FROM now)) WHERE r = 1)"""
_K = 25


def _pre(spark, sf):
    return ranking.prescore(snapshot(spark, sf)).select("insurer", "product", "pre_score", "position")


@query(f"WITH {SNAP}, {NOW}, {_PRE} SELECT * FROM pre")
def prescore(spark, sf):
    return _pre(spark, sf)


@query(f"""WITH {SNAP}, {NOW}, {_PRE}, placed AS (SELECT *, row_number() OVER (ORDER BY pre_score DESC, position, insurer, product) AS place FROM pre),
cut AS (SELECT min(pre_score) AS c FROM placed WHERE place <= {_K})
SELECT insurer, product, pre_score, position, CASE WHEN place <= {_K} THEN place END AS place,
  CASE WHEN place <= {_K} THEN 'selected' WHEN abs(pre_score - c) < 1e-9 THEN 'tied' ELSE 'dropped' END AS mark FROM placed CROSS JOIN cut""")
def select_candidates_ties(spark, sf):
    return ranking.top_with_ties(_pre(spark, sf), _K, "pre_score", "position", "insurer", "product")


@query(f"""WITH {SNAP}, {NOW}, {_PRE}, top AS (SELECT * FROM pre ORDER BY pre_score DESC, position, insurer, product LIMIT {_K})
SELECT insurer, product, pre_score FROM top WHERE (insurer, product) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size > 40)""")
def scan_candidates(spark, sf):
    top = ranking.top_with_ties(_pre(spark, sf), _K, "pre_score", "position", "insurer", "product").filter("mark = 'selected'")
    analysed = table(spark, sf, "part").filter("p_size > 40").select(F.col("p_brand").alias("insurer"), F.col("p_type").alias("product")).distinct()
    return top.join(analysed, ["insurer", "product"], "left_anti").select("insurer", "product", "pre_score")


@query(f"WITH {TARIFFS} SELECT stem, n_categories, (SELECT count(*) FROM tariffs) >= 2 AND n_categories < (SELECT greatest(3.0, 0.4 * median(n_categories)) FROM tariffs) AS low_confidence FROM tariffs")
def low_confidence(spark, sf):
    return ranking.low_confidence(tariffs(spark, sf).select("stem", "n_categories"))


@query(f"WITH {TARIFFS} SELECT stem, input_hash, n FROM (SELECT stem, input_hash, count(*) OVER (PARTITION BY input_hash) AS n FROM tariffs) WHERE n > 1")
def shared_documents(spark, sf):
    return ranking.shared_documents(tariffs(spark, sf))


@query(f"""WITH {TARIFFS}, need AS (SELECT * FROM (VALUES ('m0', 3.0::DOUBLE), ('m1', 2.0), ('m2', 0.0), ('m3', 0.0), ('m4', 1.0), ('m5', 1.0), ('m6', 1.0), ('m7', 1.0)) AS n(module, w)),
got AS (SELECT stem, sum(w) AS g FROM mods JOIN need USING (module) GROUP BY stem)
SELECT stem, coalesce(g, 0.0) / (SELECT sum(w) FROM need) AS breadth FROM tariffs LEFT JOIN got USING (stem)""")
def needs_rank(spark, sf):
    return tariffs(spark, sf).select("stem", scores.breadth(F.col("modules"), MODULES, NEEDS).alias("breadth"))


@query(f"WITH {TARIFFS} SELECT stem, coalesce(s, 0) / 16.0::DOUBLE AS tier, n_modules FROM tariffs LEFT JOIN (SELECT stem, sum(CASE level WHEN 'Komfort' THEN 1 WHEN 'Premium' THEN 2 ELSE 0 END) AS s FROM mods GROUP BY stem) USING (stem)")
def module_tiers(spark, sf):
    return tariffs(spark, sf).select("stem", scores.tier(F.col("modules"), MODULES).alias("tier"), scores.included_count(F.col("modules")).alias("n_modules"))


_ROW = "position, key, cents, note, bewertung"


@query(f"WITH {SNAP} SELECT {_ROW} FROM snap WHERE date = (SELECT max(date) FROM snap WHERE date < DATE '2001-11-01')")
def latest_snapshot(spark, sf):
    return snapshots.latest(market(spark, sf), "date", F.to_date(F.lit("2001-11-01"))).select("position", "key", "cents", "note", "bewertung")


def _dedup_sql(order: str) -> str:
    return f"WITH {SNAP}, {NOW} SELECT {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS r FROM now) WHERE r = 1"


def _row(df):
    return df.select("position", "key", "cents", "note", "bewertung")


@query(_dedup_sql("cents, position"))
def dedup_cheapest(spark, sf):
    return _row(dedup.keep_cheapest(snapshot(spark, sf), ["key"], "cents"))


@query(_dedup_sql("position"))
def dedup_first(spark, sf):
    return _row(dedup.keep_first(snapshot(spark, sf), ["key"]))


@query(_dedup_sql("position DESC"))
def dedup_last(spark, sf):
    return _row(dedup.keep_last(snapshot(spark, sf), ["key"]))


@query(f"WITH {SNAP}, {NOW} SELECT count(*) - count(DISTINCT key) AS duplicates FROM now")
def duplicate_keys(spark, sf):
    return snapshot(spark, sf).agg((F.count(F.lit(1)) - F.countDistinct("key")).alias("duplicates"))


def _diff_sql(order: str, price: str, moved: str) -> str:
    one = lambda t: f"(SELECT key, {price} AS p FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS r FROM {t}) WHERE r = 1)"
    return f"""WITH {SNAP}, {NOW}, {BEFORE} SELECT key, a.p AS old_price, b.p AS new_price, b.p - a.p AS delta,
CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' WHEN {moved} THEN 'changed' ELSE 'equal' END AS change FROM {one("before")} a FULL JOIN {one("now")} b USING (key)"""


def _pair(spark, sf):
    return snapshot(spark, sf, OLD), snapshot(spark, sf, NEW)


@query(_diff_sql("cents, position", "cents / 100.0::DOUBLE", "abs(b.p - a.p) >= 0.01"))
def snapshot_diff_tol(spark, sf):
    return snapshots.difference(*_pair(spark, sf), "key", "price", 0.01)


@query(_diff_sql("position", "(cents // 100000)::DOUBLE", "b.p <> a.p"))
def snapshot_diff_exact(spark, sf):
    rough = [d.withColumn("rough", F.floor(F.col("cents") / 100000).cast("double")) for d in _pair(spark, sf)]
    return snapshots.difference(*rough, "key", "rough", 0.0, "first")


_ROWS = f"""WITH {SNAP}, {NOW}, {BEFORE}, old1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY position) AS r FROM before) WHERE r = 1),
rows AS (SELECT n.key, n.position AS new_position, o.position AS old_position, n.price AS new_price, o.price AS old_price, n.price - o.price AS delta, o.position - n.position AS moved,
  CASE WHEN o.key IS NULL THEN 'new' ELSE 'kept' END AS state FROM now n LEFT JOIN old1 o ON o.key = n.key
UNION ALL SELECT key, NULL, position, NULL, price, NULL, NULL, 'removed' FROM before WHERE key NOT IN (SELECT key FROM now))"""


def _rows(spark, sf):
    return snapshots.row_history(*_pair(spark, sf), "key", "price", "position")


@query(f"{_ROWS} SELECT * FROM rows")
def verlauf_rows(spark, sf):
    return _rows(spark, sf)


@query(f"{_ROWS} SELECT * FROM rows WHERE delta < 0")
def verlauf_filter_cheaper(spark, sf):
    return snapshots.history_filter(_rows(spark, sf), "cheaper")


@query(f"{_ROWS} SELECT * FROM rows WHERE coalesce(delta, 0) <> 0 OR coalesce(moved, 0) <> 0 OR state IN ('new', 'removed')")
def verlauf_filter_changed(spark, sf):
    return snapshots.history_filter(_rows(spark, sf), "changed")


@query(f"""WITH {SNAP}, {NOW}, a AS (SELECT key, cents, note, bewertung FROM now), b AS (SELECT key, cents, note, bewertung FROM now WHERE position > 1)
SELECT 'reordered' AS name, true AS unchanged UNION ALL
SELECT 'shorter', NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def snapshot_unchanged(spark, sf):
    rows = snapshot(spark, sf).select("position", "key", "cents", "note", "bewertung")
    turned = rows.withColumn("position", -F.col("position"))
    a = snapshots.same_rows(rows, turned).withColumn("name", F.lit("reordered"))
    return a.unionByName(snapshots.same_rows(rows, rows.filter("position > 1")).withColumn("name", F.lit("shorter")))


@query(f"""WITH {SNAP}, {NOW}, {BEFORE}, old1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY position) AS r FROM before) WHERE r = 1),
holes AS (SELECT position, key, CASE WHEN position % 3 <> 0 THEN bewertung END AS bewertung FROM now)
SELECT h.position, h.key, coalesce(h.bewertung, o.bewertung) AS bewertung, CASE WHEN h.bewertung IS NULL AND o.bewertung IS NOT NULL THEN '{OLD}' END AS stamp FROM holes h LEFT JOIN old1 o ON o.key = h.key""")
def carry_ratings(spark, sf):
    old, new = _pair(spark, sf)
    holes = new.select("position", "key", F.when(F.col("position") % 3 != 0, F.col("bewertung")).alias("bewertung"), F.lit(None).cast("string").alias("stamp"))
    return snapshots.carried(holes, old.withColumn("stamp", F.lit(None).cast("string")), "key", ["bewertung"], "stamp", "date")


@query(f"""WITH {SNAP}, {NOW}, {BEFORE}, a AS (SELECT key, max_by(cents, position) AS p FROM before GROUP BY key), b AS (SELECT key, max_by(cents, position) AS p FROM now GROUP BY key), j AS (SELECT a.p AS x, b.p AS y FROM a FULL JOIN b USING (key))
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS common, count(*) FILTER (x <> y) AS repriced, count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS removed FROM j""")
def compare_counts(spark, sf):
    return snapshots.comparison_counts(*_pair(spark, sf), "key", "cents")


_SERIES = """priced AS (SELECT stem, date, band, min(price) AS price FROM snap GROUP BY ALL),
pin AS (SELECT stem, band FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, low, band) AS r FROM (SELECT stem, band, count(*) AS n, min(price) AS low FROM priced GROUP BY ALL)) WHERE r = 1),
series AS (SELECT d.stem, d.date, pin.band, p.price FROM (SELECT DISTINCT stem, date FROM snap) d JOIN pin USING (stem) LEFT JOIN priced p ON p.stem = d.stem AND p.date = d.date AND p.band = pin.band)"""
_CHANGES = f"{_SERIES}, changes AS (SELECT stem, date, old_price, price AS new_price, price - old_price AS delta FROM (SELECT *, lag(price) OVER (PARTITION BY stem ORDER BY date) AS old_price FROM series WHERE price IS NOT NULL) WHERE abs(price - old_price) > 0.005)"


def _series(spark, sf):
    return series.pinned_series(market(spark, sf, places=False))


@query(f"WITH {SNAP}, {_SERIES} SELECT * FROM series")
def pinned_price_series(spark, sf):
    return _series(spark, sf)


@query(f"WITH {SNAP}, {_CHANGES} SELECT * FROM changes")
def price_changelog(spark, sf):
    return series.price_changes(_series(spark, sf))


@query(f"WITH {SNAP}, {_CHANGES} SELECT stem, count(*) AS n_changes, max(date) AS last_change FROM changes GROUP BY stem")
def price_change_count(spark, sf):
    return series.change_summary(_series(spark, sf))


_FIGURES = "figures AS (SELECT date, count(*) AS n, count(price) AS n_priced, min(price) AS lowest, median(price) AS median_price, max(price) AS highest FROM snap GROUP BY date)"


@query(f"WITH {SNAP}, {_FIGURES} SELECT * FROM figures")
def market_stats(spark, sf):
    return series.market_figures(market(spark, sf, places=False))


_QUARTILES = "quartiles AS (SELECT date, l[len(l) // 4 + 1] AS q1, l[len(l) // 2 + 1] AS q2, l[3 * len(l) // 4 + 1] AS q3 FROM (SELECT date, list(price ORDER BY price) AS l FROM snap GROUP BY date))"


@query(f"WITH {SNAP}, {_QUARTILES} SELECT * FROM quartiles")
def price_quartiles(spark, sf):
    return series.quartiles(market(spark, sf, places=False), ["date"])


@query(f"""WITH {SNAP}, {NOW}, {_QUARTILES} SELECT key, position, CASE WHEN price <= q1 THEN 'cheap' WHEN price >= q3 THEN 'expensive' ELSE 'middle' END AS band_of_price,
CASE WHEN note <= 1.3 THEN 'good' WHEN note <= 2.0 THEN 'fair' ELSE 'weak' END AS band_of_note FROM now JOIN quartiles USING (date)""")
def price_bands(spark, sf):
    rows = snapshot(spark, sf)
    q = F.broadcast(series.quartiles(rows, ["date"]))  # one row
    return rows.join(q, "date").select("key", "position", display.price_band(F.col("price"), F.col("q1"), F.col("q3")).alias("band_of_price"), display.grade_band(F.col("note")).alias("band_of_note"))


@query(f"WITH {SNAP}, {_FIGURES} SELECT date, n, median_price, median_price - lag(median_price) OVER w AS median_delta, n - lag(n) OVER w AS n_delta FROM figures WINDOW w AS (ORDER BY date)")
def market_pulse(spark, sf):
    return series.pulse(series.market_figures(market(spark, sf, places=False)))


@query(f"""WITH {SNAP}, {_SERIES}, b AS (SELECT stem, min(price) AS lo, max(price) AS hi FROM series GROUP BY stem)
SELECT stem, string_agg(CASE WHEN price IS NULL THEN '·' WHEN hi = lo THEN '▅' ELSE substring('▁▂▃▄▅▆▇█', CAST(floor((price - lo) / (hi - lo) * 7) AS INT) + 1, 1) END, '' ORDER BY date) AS spark FROM series JOIN b USING (stem) GROUP BY stem""")
def sparkline(spark, sf):
    return series.as_array(_series(spark, sf)).select("stem", display.sparkline(F.col("prices")).alias("spark"))


@query(f"""WITH {SNAP}, {_SERIES} SELECT stem, string_agg(CASE WHEN price IS NULL THEN '-' ELSE CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR) END, ',' ORDER BY date) AS last_points
FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY date DESC) AS r FROM series) WHERE r <= 8 GROUP BY stem""")
def last_price_points(spark, sf):
    last = F.when(F.size("prices") > 8, F.slice("prices", -8, 8)).otherwise(F.col("prices"))
    cents = F.transform(last, lambda p: F.coalesce(F.round(p * 100).cast("long").cast("string"), F.lit("-")))
    return series.as_array(_series(spark, sf)).select("stem", F.array_join(cents, ",").alias("last_points"))
