"""URL filtering: host rules first, then a ratio of two character language models.

Two interpolated Markov models over URL characters, one of the URLs that rules accept and one of those they
reject, use every history up to ``order - 1`` characters that they have seen (Witten-Bell weights). A URL that no
rule decides is judged by the difference of its log-likelihoods per character against a threshold that is
calibrated on rule-decided URLs that the models have not seen: those whose digest begins with one of HELD_OUT.

Everything is DataFrame operations. The symbols are folded to an alphabet of at most 42, so the n-gram tables have
a size bound that does not depend on the number of pages.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged as the
text that is there (an empty one by the difference 0). Rows that repeat are judged alike, each on its own row.
If rules decide no page one way, that model is uniform, and where none of a side is held out the threshold is 0. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER = 4
#: First digits of a URL's MD5 digest by which a rule-decided page is kept for calibration: three sixteenths of all.
HELD_OUT = "012"
ALPHABET = 42
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    # What stands behind the first "://"; the host ends at the first of / ? #, the path at the first ? or #.
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), *LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    best = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | F.endswith(host, F.lit("." + r[1]))) & F.startswith(path, F.lit(r[2]))
    rule = F.coalesce(*(F.when(fits(r), F.lit(r[1] + r[2])) for r in best))
    verdict = F.coalesce(*(F.when(fits(r), F.lit(r[0])) for r in best))
    return rule, verdict


def _folded(url: Column) -> Column:
    lowered = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.regexp_replace(lowered, r"(?s)[^a-z0:/?#.=&_%~+,;@-]", "*")


def _grams(rows: DataFrame) -> DataFrame:
    """A row for each character of a URL with its history; ^ stands before the start. What is held out counts as not known."""
    # An empty URL has none: a sequence from 1 to 0 would count down.
    padded = rows.filter(F.length("folded") > 0).withColumn("p", F.concat(F.lit("^" * (ORDER - 1)), "folded"))
    at = padded.select("page_row", F.when(~F.col("held"), F.col("known")).alias("known"), "p", F.explode(F.sequence(F.lit(1), F.length("folded"))).alias("i"))
    return at.select("page_row", "known", F.substring("p", F.col("i"), F.lit(ORDER)).alias("gram"))


def _model(counts: DataFrame) -> DataFrame:
    """gram -> log ratio of the two smoothed models, for each n-gram that occurs in any page."""
    sides = ("allow", "block")
    # The last k characters of every n-gram, all orders in one table: each order is a step of the same plan, not a plan around the last.
    tails = counts.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(ORDER)))).withColumn("tail", F.substring("gram", F.lit(ORDER + 1) - F.col("k"), F.col("k")))
    alike = Window.partitionBy("k", F.substring("tail", F.lit(1), F.col("k") - 1))
    seen = (
        tails.groupBy("k", "tail").agg(*(F.sum(s).alias(f"{s}_c") for s in sides))
        .select("*", *(F.sum(f"{s}_c").over(alike).alias(f"{s}_n") for s in sides), *(F.count_if(F.col(f"{s}_c") > 0).over(alike).alias(f"{s}_t") for s in sides))
    )
    facts = [f"{s}_{x}" for s in sides for x in "cnt"]
    table = tails.select("gram", "k", "tail").join(seen, ["k", "tail"]).groupBy("gram").agg(
        *(F.max(F.when(F.col("k") == k, F.col(x))).alias(f"{x}{k}") for k in range(1, ORDER + 1) for x in facts)
    )
    probability = {s: F.lit(1.0 / ALPHABET) for s in sides}
    for k in range(1, ORDER + 1):
        for s in sides:
            n, t = F.col(f"{s}_n{k}"), F.greatest(F.col(f"{s}_t{k}"), F.lit(1))
            probability[s] = (F.col(f"{s}_c{k}") + t * probability[s]) / (n + t)
    return table.select("gram", (F.ln(probability["allow"]) - F.ln(probability["block"])).alias("llr"))


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the score of the models with the threshold they were held against."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = stage(
        pages.select("page_id", F.col("url").cast("string").alias("url"))
        .select("page_id", "url", host.alias("host"), path.alias("path"), _folded(F.col("url")).alias("folded"))
        .select("*", rule.alias("rule"), verdict.alias("known"), F.monotonically_increasing_id().alias("page_row"))
        .withColumn("held", F.col("known").isNotNull() & F.substring(F.md5("folded"), 1, 1).isin(*HELD_OUT))
    )
    counts = stage(
        _grams(rows)
        .groupBy("gram")
        .agg(*(F.count_if(F.col("known") == s).alias(s) for s in ("allow", "block")))
    )
    model = broadcast_if_small(stage(_model(counts)))
    # A page's characters stay in one task up to here, so that each page sends about one row into the sum.
    scores = _grams(rows).join(model, "gram").groupBy("page_row").agg(F.avg("llr").alias("llr"))
    scored = stage(rows.join(scores, "page_row", "left").withColumn("score", F.coalesce("llr", F.lit(0.0))))
    at = scored.filter("held").groupBy().agg(
        *(f(F.when(F.col("known") == s, F.col("score"))).alias(f"{s}_{n}") for s in ("allow", "block") for n, f in (("m", F.avg), ("s", F.stddev_pop)))
    ).first()
    threshold = _threshold(at["allow_m"], at["allow_s"], at["block_m"], at["block_s"])
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("known", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        "score", F.lit(threshold).alias("threshold"),
    )


def _threshold(allow_mean, allow_dev, block_mean, block_dev) -> float:
    """Where two normal curves with the sides' means and deviations leave equal shares on the wrong side; 0 if a side is empty."""
    if allow_mean is None or block_mean is None:
        return 0.0
    allow_dev, block_dev = allow_dev + 1e-6, block_dev + 1e-6
    return (allow_mean * block_dev + block_mean * allow_dev) / (allow_dev + block_dev)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score", "threshold")


def _sql() -> str:
    """The same in SQL: the rules, the two models of every order, the calibrated threshold."""
    best = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda part: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{part(r)}'" for r in best) + " END"
    steps, p = [], {s: f"1.0::DOUBLE / {ALPHABET}" for s in ("allow", "block")}
    joins = ""
    for k in range(1, ORDER + 1):
        steps.append(
            f"g{k} AS (SELECT right(gram, {k}) AS g, left(right(gram, {k}), {k - 1}) AS h, sum(allow) AS a, sum(block) AS b FROM counts GROUP BY ALL), "
            f"n{k} AS (SELECT h, sum(a) AS an, count(*) FILTER (a > 0) AS at, sum(b) AS bn, count(*) FILTER (b > 0) AS bt FROM g{k} GROUP BY h)"
        )
        joins += f" JOIN g{k} ON g{k}.g = right(gram, {k}) JOIN n{k} ON n{k}.h = g{k}.h"
        for s in p:
            t = f"greatest(n{k}.{s[0]}t, 1)"
            p[s] = f"(g{k}.{s[0]} + {t} * ({p[s]}))::DOUBLE / (n{k}.{s[0]}n + {t})"
    return rf"""
WITH parts AS (
  SELECT page_id, url, contains(coalesce(url, ''), '://') AS has,
         regexp_extract(coalesce(url, ''), '(?s)\A.*?://(.*)\z', 1) AS rest FROM pages),
split AS (
  SELECT page_id, url,
         CASE WHEN has THEN translate(regexp_extract(rest, '\A([^/?#]*)', 1), '{LOWER[0]}', '{LOWER[1]}') ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM parts),
base AS (
  SELECT row_number() OVER () AS page_row, page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS known,
         regexp_replace(regexp_replace(lower(coalesce(url, '')), '[0-9]', '0', 'g'), '(?s)[^a-z0:/?#.=&_%~+,;@-]', '*', 'g') AS folded
  FROM split),
marked AS (SELECT *, known IS NOT NULL AND left(md5(folded), 1) IN ({", ".join(f"'{c}'" for c in HELD_OUT)}) AS held FROM base),
places AS (SELECT page_row, CASE WHEN NOT held THEN known END AS known, repeat('^', {ORDER - 1}) || folded AS p, unnest(range(1, length(folded) + 1)) AS i FROM marked),
grams AS (SELECT page_row, known, substring(p, i, {ORDER}) AS gram FROM places),
counts AS (SELECT gram, count(*) FILTER (known = 'allow') AS allow, count(*) FILTER (known = 'block') AS block FROM grams GROUP BY gram),
{", ".join(steps)},
model AS (SELECT gram, ln({p["allow"]}) - ln({p["block"]}) AS llr FROM counts{joins}),
scored AS (
  SELECT marked.*, coalesce(score, 0) AS score FROM marked
  LEFT JOIN (SELECT page_row, avg(llr) AS score FROM grams JOIN model USING (gram) GROUP BY page_row) USING (page_row)),
m AS (
  SELECT avg(score) FILTER (known = 'allow') AS am, stddev_pop(score) FILTER (known = 'allow') + 1e-6 AS ad,
         avg(score) FILTER (known = 'block') AS bm, stddev_pop(score) FILTER (known = 'block') + 1e-6 AS bd FROM scored WHERE held)
SELECT page_id, host, path, rule,
       coalesce(known, CASE WHEN score >= coalesce((am * bd + bm * ad) / (ad + bd), 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM scored CROSS JOIN m
"""


OP3_SQL = _sql()
