"""What larger tables have broken or made slow."""

import datetime
import random
import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.operators import trimming
from ledgerloom.streaming import keyed_state


def against_sql(spark, folder, name, **tables):
    """Rows of a query over these tables that its SQL has not, and the other way round."""
    con = duckdb.connect()
    for t, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    __spark_entry__.queries()[name](spark, str(folder)).write.parquet(f"{folder}/got")
    con.execute(f"CREATE TABLE want AS {__spark_entry__.oracle_sql()[name]}")
    columns = ", ".join(c for c, *_ in con.execute("DESCRIBE want").fetchall())
    got, want = f"SELECT {columns} FROM read_parquet('{folder}/got/*.parquet')", "SELECT * FROM want"
    return con.execute(f"({got} EXCEPT ALL {want}) UNION ALL ({want} EXCEPT ALL {got})").fetchall()


def parts(spark, n, stems=3):
    """Parts of few stems, whose lists are of different lengths."""
    k, few = F.col("id"), F.floor(F.sqrt(F.col("id") % (stems * stems)))
    name = F.concat_ws(" ", F.lit("bolt"), F.concat(F.lit("n"), (k % 40).cast("string")))
    return spark.range(n).select(k.alias("p_partkey"), name.alias("p_name"), F.concat(F.lit("Brand#"), few.cast("string")).alias("p_brand"), F.lit("PROMO").alias("p_type"), (k % 50 + 1).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))


def test_lists_of_other_lengths_are_united_row_by_row(spark, tmp_path):
    assert against_sql(spark, tmp_path, "reconcile_merge", part=parts(spark, 3000)) == []


def test_streams_do_not_depend_on_the_groups_of_keys(spark, tmp_path):
    """Many keys share a group's state: late and waiting days of each are its own."""
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    batches = [[(k, at((7 * k + 11 * i + 40 * b) % 90 + 30 * b), float((k * i) % 4)) for k in range(20) for i in range(6)] for b in range(2)]
    logs = []
    for groups in (1, 50):
        for batch in batches:
            df = spark.createDataFrame(batch, "stem long, at timestamp, price double")
            df.write.mode("append").parquet(f"{tmp_path}/in{groups}")
            stream = keyed_state.price_events(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in{groups}"), "20 days", groups=groups)
            keyed_state.drained(stream, f"{tmp_path}/out{groups}", f"{tmp_path}/check{groups}")
        logs.append(sorted(map(str, spark.read.parquet(f"{tmp_path}/out{groups}").collect())))
    assert logs[0] == logs[1] and len(logs[0]) > 20


def test_names_of_files_are_read_once(spark):
    """Before, filters on what names say were pushed below their parsing, and read each name again for every file."""
    found = __spark_entry__.queries()["orphan_stems"](spark, "/root/testdata/sf0.001")
    assert "p_brand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_trimming_is_dealt_to_a_number_of_partitions(spark):
    """Before, adaptive plans merged the partitions in which texts are trimmed, few bytes that take long."""
    for name in ("rescored_runs", "rescored_cells", "trim_budget_in_blocks", "trim_in_blocks"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"RepartitionByExpression \[.*\], 4", plan), name


def test_lines_end_where_they_did(spark):
    rnd = random.Random(5)
    ends = ["\n", "\r", "\r\n", "\n\r", "\x0b", "\x0b\n", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", " \n", "a", "b-\nc"]
    texts = ["", "\n", "\n\n", "a\n", None, *("".join(rnd.choices(ends, k=rnd.randrange(12))) for _ in range(3000))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trimming.lines(F.col("t")).alias("ls")).collect()
    assert all((r.ls is None) if r.t is None else r.ls == (r.t.splitlines() or [""]) for r in got)
