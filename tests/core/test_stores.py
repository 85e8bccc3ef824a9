import datetime
import json
import random

from pyspark.sql import functions as F

from railspan.operators import connections as co
from railspan.operators import partials as pa
from railspan.sources import daily, tables

DAY = datetime.date(2025, 3, 1)
MEASURES = [pa.Measure("n", "sum"), pa.Measure("total", "sum", "v"), pa.Measure("least", "min", "v"), pa.Measure("most", "max", "v"), pa.Measure("trains", "distinct", "train")]


def day(n):
    return DAY + datetime.timedelta(n)


def test_refreshed_partials_equal_recomputed_ones(spark, tmp_path):
    r = random.Random(2)
    rows = [(day(r.randrange(9)), r.choice(("a", "b", None)), r.choice((None, *range(50))), r.choice((None, "1", "2", "3"))) for _ in range(400)] + [(None, "a", 1, "9")]
    df = spark.createDataFrame(rows, "day_date date, station string, v int, train string")
    path = str(tmp_path / "p")
    for last in (3, 3, 6, 20):  # a run again changes nothing
        pa.refresh(df.filter(F.col("day_date") <= day(last)), path, ["station"], MEASURES)
    known = df.filter("day_date is not null")
    want = known.groupBy("station").agg(F.countDistinct("day_date"), F.count("*"), F.sum("v"), F.min("v"), F.max("v"), F.countDistinct("train"))
    got = pa.merged(spark.read.parquet(path), ["station"], MEASURES)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    changed = df.withColumn("v", F.when(F.col("day_date") == day(4), F.lit(1000)).otherwise(F.col("v")))
    pa.refresh(changed, path, ["station"], MEASURES, again=spark.createDataFrame([(day(4),)], "day_date date"))
    assert pa.merged(spark.read.parquet(path), ["station"], MEASURES).agg(F.max("most")).first()[0] == 1000


def test_sketches_stay_within_their_error(spark, tmp_path):
    rows = spark.range(60_000).select(F.date_add(F.lit(DAY), (F.col("id") % 5).cast("int")).alias("day_date"), F.lit("a").alias("station"), (F.col("id") % 20_011).alias("train"))
    m = [pa.Measure("trains", "distinct", "train")]
    pa.refresh(rows, str(tmp_path / "p"), ["station"], m)
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert pa.merged(stored, ["station"], m).first().trains == 20_011
    assert abs(pa.merged(stored, ["station"], m, sketches=True).first().trains / 20_011 - 1) < 3 * 1.04 / 2 ** (pa.SKETCH_BITS / 2)
    assert pa.merged(stored.limit(0), ["station"], m).count() == 0


def test_stored_sides_meet_without_a_shuffle(spark):
    r = random.Random(4)
    rows = [(day(r.randrange(2)), 1, r.choice("ab"), str(r.randrange(30)), "L", r.choice((None, -1, 28800 + 60 * r.randrange(90))), 28800 + 60 * r.randrange(90), r.randrange(300), r.randrange(200)) for _ in range(300)]
    rec = spark.createDataFrame(rows, "day_date date, dow int, station string, train_no string, relation string, arr_sec long, dep_sec long, delay_arr long, delay_dep long")
    tables.store_sides(rec, "some_sides", buckets=3)
    got, want = tables.stored_connections(spark, "some_sides"), co.connections(rec)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(map(repr, df.select(want.columns).collect()))
    assert key(got) == key(want) and want.count() > 100
    tables.store_sides(rec.limit(0), "no_sides", buckets=3)
    assert tables.stored_connections(spark, "no_sides").count() == 0


def put(folder, n, lines, name="a.json"):
    at = folder / f"day_date={day(n).isoformat()}"
    at.mkdir(parents=True, exist_ok=True)
    (at / name).write_text("\n".join(lines))


SCHEMA = "train_no string, delay_arr long, day_date date"


def test_days_are_pruned_and_lost_days_are_null(spark, tmp_path):
    daily.use_daily_records(spark)
    for n in range(6):
        put(tmp_path, n, [json.dumps({"train_no": str(k), "delay_arr": k * n, "more": 1}) for k in range(3)])
    put(tmp_path, 6, [json.dumps({"train_no": "x"}), '{"train_no": "broken'])
    (tmp_path / f"day_date={day(7).isoformat()}").mkdir()
    read = spark.read.format("daily_records").option("path", str(tmp_path)).schema(SCHEMA).load()
    got = sorted(map(repr, map(tuple, read.collect())))
    assert got == sorted(map(repr, [(str(k), k * n, day(n)) for n in range(6) for k in range(3)] + [(None, None, day(6)), (None, None, day(7))]))
    some = read.filter((F.col("day_date") >= F.lit(day(1))) & (F.col("day_date") < F.lit(day(3))) & (F.col("train_no") == "2"))
    assert some.rdd.getNumPartitions() == 2 and read.rdd.getNumPartitions() == 8
    assert sorted(x.delay_arr for x in some.collect()) == [2, 4]
    assert read.filter(F.col("day_date") == F.lit(day(99))).count() == 0
    assert spark.read.format("daily_records").option("path", str(tmp_path / "none")).schema(SCHEMA).load().count() == 0


def test_the_same_days_as_a_stream(spark, tmp_path):
    daily.use_daily_records(spark)
    stream = lambda: spark.readStream.format("daily_records").option("path", str(tmp_path / "in")).schema(SCHEMA).load()
    for n in range(4):
        put(tmp_path / "in", n, [json.dumps({"train_no": str(n), "delay_arr": n})])
        if n % 2:
            q = stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
            q.processAllAvailable()
            q.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(str(n), n, day(n)) for n in range(4)]
