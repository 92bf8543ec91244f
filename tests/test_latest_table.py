"""Latest versions as base and deltas, against the plain form over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from thresher.operators.results import latest_versions, live_results, results_last_hours
from thresher.session import finished_epochs, scratch_path
from thresher.sources.latest_table import LatestTable

SCHEMA = "ruleId string, groupKey string, windowStart string, windowEnd string, producedAt string, cnt long, isFinal boolean, seq long"


def message(i, rng, day=None):
    rule = rng.choice(["a", "a", "a", "b", None])
    start = f"2024-01-{day or rng.randint(1, 8):02d} {rng.randint(0, 3):02d}:00:00"
    start = rng.choice([start] * 12 + [None, "", "1704067200000", "soon"])
    return (rule, rng.choice(["g1", "g2", None]), start, "e", f"2024-02-01 00:00:{rng.randint(0, 59):02d}", i, rng.random() < 0.3, i)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def table(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    return LatestTable(spark, scratch_path(spark, "latest"), schema, buckets=2, base_every=3)


def fill(spark, table, batches=7, size=60, seed=1):
    rng, seen = random.Random(seed), []
    for epoch in range(batches):
        more = [message(epoch * size + i, rng) for i in range(size)]
        seen += more
        table.fold(spark.createDataFrame(more, SCHEMA), epoch)
    return spark.createDataFrame(seen, SCHEMA)


def test_equals_latest_versions(spark, table):
    whole = fill(spark, table)
    assert finished_epochs(spark, f"{table.path}/counts/base") == [2, 5]
    assert rows_of(table.read()) == rows_of(latest_versions(whole))
    assert rows_of(table.read(3)) == rows_of(latest_versions(whole.where("seq < 240")))
    assert rows_of(live_results(table.rows(["a"]), "a")) == rows_of(live_results(whole, "a"))
    import datetime as dt

    now = dt.datetime(2024, 1, 8, 12)
    assert rows_of(results_last_hours(table.rows(first_day="2024-01-04"), [], 96, now)) == rows_of(results_last_hours(whole, [], 96, now))


@pytest.mark.parametrize("limit", [1, 5, 40, 1000])
def test_newest_reads_the_newest_days(spark, table, limit):
    whole = fill(spark, table)
    got = table.newest("a", limit)
    want = live_results(whole, "a", limit)
    order = [F.col("windowStart").desc(), "ruleId", "groupKey"]
    assert [tuple(r) for r in got.orderBy(*order).collect()] == [tuple(r) for r in want.orderBy(*order).collect()]
    if limit <= 5:  # four hours x three groups a day
        days = {f.split("__day=")[1][:10] for f in got.inputFiles() if "__day=other" not in f}
        assert len(days) <= 3 and len(got.inputFiles()) < len(table.rows().inputFiles()) / 2


def test_limits_out_of_range(table):
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            table.newest("a", limit)


def test_late_row_rewrites_its_cell_alone(spark, table):
    rng = random.Random(2)
    for epoch in range(3):
        table.fold(spark.createDataFrame([message(epoch * 100 + i, rng) for i in range(100)], SCHEMA), epoch)
    late = ("a", "g1", "2024-01-02 00:00:00", "e", "2025-01-01 00:00:00", -1, True, 10**6)
    for epoch in (3, 4, 5):
        table.fold(spark.createDataFrame([late], SCHEMA), epoch)
    cells = {f.rsplit("/", 1)[0] for f in spark.read.parquet(f"{table.path}/base/epoch=5").inputFiles()}
    assert len(cells) == 1
    assert len({f.rsplit("/", 1)[0] for f in spark.read.parquet(f"{table.path}/base/epoch=2").inputFiles()}) > 10
    assert late in [tuple(r) for r in table.read().collect()]


def test_epoch_run_again_and_unfinished_epoch(spark, table):
    whole = fill(spark, table, batches=6)
    want = rows_of(latest_versions(whole))
    table.fold(whole.where("seq >= 300"), 5)  # a merging epoch once more
    assert rows_of(table.read()) == want
    table._write(latest_versions(whole.withColumn("cnt", F.lit(-5).cast("long"))), "delta", 6)  # died before its counts
    assert rows_of(table.read()) == want
    table.fold(whole.where("seq < 0"), 6)  # an empty batch
    assert rows_of(table.read()) == want


def test_nothing_yet(spark, table):
    assert table.read().count() == 0 and table.newest("a", 5).count() == 0
    table.fold(spark.createDataFrame([], SCHEMA), 0)
    assert table.read().count() == 0


def test_expire_keeps_what_reads_meet(spark, table):
    whole = fill(spark, table, batches=10)
    before = rows_of(table.read())
    table.expire(keep=2)
    assert rows_of(table.read()) == before == rows_of(latest_versions(whole))
    assert rows_of(table.read(6)) == rows_of(latest_versions(whole.where("seq < 420")))
    assert finished_epochs(spark, f"{table.path}/delta") == [6, 7, 8, 9]
    assert finished_epochs(spark, f"{table.path}/counts/base") == [5, 8]


def test_as_a_stream(spark, table):
    rng = random.Random(3)
    whole = spark.createDataFrame([message(i, rng) for i in range(200)], SCHEMA)
    inbox = scratch_path(spark, "latest-inbox")
    whole.repartition(5).write.parquet(inbox)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    checkpoint = scratch_path(spark, "latest-checkpoint")
    for _ in range(2):  # a restart changes nothing
        stream.writeStream.foreachBatch(table.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        assert rows_of(table.read()) == rows_of(latest_versions(whole))
