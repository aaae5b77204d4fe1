"""Physical plans: what is pushed down, what is not joined, and how hot keys are split."""

import pytest
from pyspark.sql import functions as F

from siftdesk.operators import listing, metrics, relations
from siftdesk.operators.sequences import find_hot, lookup, with_position
from siftdesk.sources import tables

def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """Tables as files, so that scans show what reaches them."""
    tickets = spark.range(2000).select(
        F.col("id").cast("string").alias("id"),
        *[F.lit("x").alias(c) for c in ("title", "description", "status", "source", "submitter_email", "assigned_to")],
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id)").alias("created_at"),
        F.expr("timestamp_ntz'2024-01-01'").alias("updated_at"),
    )
    enrichments = spark.range(2000).selectExpr(
        "cast(id as string) ticket_id", "'low' severity", "'billing' category", "cast(0.5 as decimal(4,3)) confidence"
    )
    tickets.write.parquet(str(tmp_path / "t"))
    enrichments.write.parquet(str(tmp_path / "e"))
    return spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "e"))


def test_cursor_reaches_the_scan(stored):
    tickets, _ = stored
    after = listing.after_cursor(tickets, F.expr("timestamp_ntz'2024-01-02'"), F.lit("7"))
    plan = plan_of(listing.order_tickets(after).limit(21))
    assert "Or(LessThan(created_at" in plan and "TakeOrderedAndProject" in plan


def test_page_rows_are_fetched_by_key(stored):
    plan = plan_of(listing.list_page(*stored, limit=5).items)
    assert "In(ticket_id, [" in plan and "GreaterThanOrEqual(created_at" in plan
    assert " IN (1999,1998,1997,1996,1995)" in plan


def test_total_reads_enrichments_only_if_filtered(stored):
    plain = plan_of(listing.list_total(*stored, status="x"))
    assert "Join" not in plain and plain.count("FileScan") == plain.count("ReadSchema: struct<status:string>")
    filtered = plan_of(listing.list_total(*stored, severity="low"))
    assert "LeftSemi" in filtered and "EqualTo(severity,low)" in filtered


def test_filter_on_enrichment_makes_the_join_inner(stored):
    plan = plan_of(listing.filter_tickets(listing.list_items(*stored), severity="low"))
    assert "Inner" in plan and "LeftOuter" not in plan


def test_copies_are_dropped_before_the_shuffle(stored):
    plan = plan_of(relations.earliest_per(stored[0], "status", ["created_at", "id"]))
    shuffle = plan.index("Exchange")
    assert "WindowGroupLimit" in plan[shuffle:] and "Partial" in plan[shuffle:]


def test_counts_read_one_column(stored):
    plan = plan_of(metrics.count_by(stored[0], "status"))
    assert "ReadSchema: struct<status:string>" in plan and "partial_count" in plan


def test_bucketed_tables_join_without_a_shuffle(spark, stored, tmp_path):
    tickets, enrichments = stored
    expected = listing.list_items(tickets, enrichments).count()
    tables.save_bucketed(tickets, "bucketed_t", "id", 4, str(tmp_path / "bt"))
    tables.save_bucketed(enrichments, "bucketed_e", "ticket_id", 4, str(tmp_path / "be"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = listing.list_items(spark.table("bucketed_t"), spark.table("bucketed_e"))
        assert "Exchange" not in plan_of(items) and items.count() == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucketed_t", "bucketed_e"):
            spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def skewed(spark):
    """Joins by shuffle, with partitions called skewed early."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("ticket_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("new_value"),
    )
    for key in settings:
        spark.conf.unset(key)


def test_hot_ticket_is_split_in_the_orphan_check(spark, skewed):
    found = relations.orphans(skewed, spark.range(30_000))
    assert found.count() == 20_000
    rows = found.toPandas()
    assert len(rows) == 20_000 and "SortMergeJoin(skew=true)" in plan_of(found)


def test_hot_key_is_looked_up_apart(spark, skewed):
    side = spark.range(60_000).select(F.col("id").alias("ticket_id"), (F.col("id") * 2).alias("double"))
    hot = find_hot(skewed, "ticket_id", 1000)
    joined = lookup(skewed, side, hot, "inner")
    assert joined.count() == 60_000
    assert joined.where(F.col("double") != F.col("ticket_id") * 2).count() == 0


def test_hot_keys_are_found(spark, skewed):
    hot = find_hot(skewed, "ticket_id", 1000)
    assert [r.ticket_id for r in hot.keys.collect()] == [0] and hot.slices == 21
    assert find_hot(skewed, "ticket_id").keys is None


def test_any_number_of_hot_keys_and_a_null_one(spark):
    rows = [(None if i % 4 == 0 else i % 60, i) for i in range(1200)]
    df = spark.createDataFrame(rows, "ticket_id int, seq int")
    side = spark.createDataFrame([(i, i * 10) for i in range(50)], "ticket_id int, tens int")
    hot = find_hot(df, "ticket_id", 5)
    keys = {r.ticket_id for r in hot.keys.collect()}
    assert None in keys and len(keys) == 46
    assert hot.rest(df).count() == 0 and hot.only(df).count() == 1200
    for found in (hot, find_hot(df, "ticket_id")):
        left = lookup(df, side, found)
        want = sorted((k, n, k * 10 if k is not None and k < 50 else None) for k, n in rows if k is not None)
        assert sorted(tuple(r) for r in left.where("ticket_id is not null").collect()) == want
        nulls = left.where("ticket_id is null").collect()
        assert len(nulls) == 300 and all(r.tens is None for r in nulls)
        assert lookup(df, side, found, "inner").where("ticket_id is null").count() == 0
    windowed = with_position(df, ["ticket_id"], [F.col("seq")], hot)
    plain = with_position(df, ["ticket_id"], [F.col("seq")], find_hot(df, "ticket_id"))
    assert sorted(map(tuple, windowed.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
