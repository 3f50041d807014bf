"""Set, remove, has and get of inputs over a stream that is stopped and started again."""

import pytest

from tessera.streaming import inputs

SCHEMA = "key string, seq long, op string, value string"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, inputs.PROVIDER)
    yield
    spark.conf.set(name, before)


def test_a_restart_goes_on_from_the_state(spark, store, tmp_path):
    source, checkpoint, sink = f"{tmp_path}/in", f"{tmp_path}/checkpoint", f"{tmp_path}/out"
    batches = [
        [("a", 1, "set", "x"), ("a", 2, "set", "x"), ("b", 3, "set", None), ("c", 4, "remove", None), ("b", 5, "set", None)],
        [("a", 6, "remove", None), ("b", 7, "set", "y"), ("a", 2, "set", "old"), ("a", 8, "remove", None), ("d", 9, "set", "z")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = inputs.applied(spark.readStream.schema(SCHEMA).parquet(source))
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.key, r.seq, r.outcome) for r in spark.read.parquet(sink).collect())
    assert got == [
        ("a", 1, "changed"), ("a", 2, "late"), ("a", 2, "same"), ("a", 6, "removed"), ("a", 8, "absent"),
        ("b", 3, "changed"), ("b", 5, "same"), ("b", 7, "changed"), ("c", 4, "absent"), ("d", 9, "changed"),
    ]
    assert {(r.key, r.value) for r in inputs.held(spark, checkpoint).collect()} == {("b", "y"), ("d", "z")}
