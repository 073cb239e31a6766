from rillet.session import scratch_path
from rillet.streaming import file_arrival_stream, run_available, stream_filter

EVENTS = "/root/testdata/sf0.001"


def test_stream_filter_equals_batch_and_rerun_adds_nothing(spark):
    batch = spark.read.parquet(f"{EVENTS}/events.parquet")
    sink = scratch_path(spark, "sink")
    stream = file_arrival_stream(spark, EVENTS, batch.schema, pathGlobFilter="events.parquet")
    ckpt = run_available(stream_filter(stream, "value > 100"), sink)
    got = spark.read.parquet(sink)
    want = batch.where("value > 100")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    stream2 = file_arrival_stream(spark, EVENTS, batch.schema, pathGlobFilter="events.parquet")
    run_available(stream_filter(stream2, "value > 100"), sink, checkpoint=ckpt)
    assert spark.read.parquet(sink).count() == want.count()


def test_stateless_steps_compose_on_a_stream(spark):
    from rillet import operators as op
    from rillet.plans import chain

    batch = spark.read.parquet(f"{EVENTS}/events.parquet")
    steps = chain(lambda d: op.filter_rows(d, "event_type <> 'error'"),
                  lambda d: op.json_flatten(d, "props", schema="k bigint"),
                  lambda d: op.data_masking(d, "event_type", "hash"),
                  lambda d: op.conditional_split(d, [{"condition": "value > 100", "output": "high"}]).tagged)
    sink = scratch_path(spark, "sink2")
    stream = file_arrival_stream(spark, EVENTS, batch.schema, pathGlobFilter="events.parquet")
    run_available(steps(stream), sink)
    got, want = spark.read.parquet(sink), steps(batch)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_stream_static_join(spark):
    from rillet import operators as op

    batch = spark.read.parquet(f"{EVENTS}/events.parquet")
    users = spark.read.parquet(f"{EVENTS}/customer.parquet").selectExpr("c_custkey AS user_id", "c_mktsegment")
    sink = scratch_path(spark, "sink3")
    stream = file_arrival_stream(spark, EVENTS, batch.schema, pathGlobFilter="events.parquet")
    run_available(op.join(stream, users, "user_id", "left"), sink)
    assert spark.read.parquet(sink).count() == op.join(batch, users, "user_id", "left").count()
