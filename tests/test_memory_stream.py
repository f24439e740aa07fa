"""Conversation memory of a stream against the same turns as a table, over restarts, and what is forgotten."""

import time

import pytest

from umbra.operators.dialogue import last_messages
from umbra.streaming.memory import STORE, remembered

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def stored(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def consumed(spark, source, place, **options):
    """All that is new in a folder, through the stream; what each batch says is kept."""
    said = []
    stream = remembered(spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(source), **options)
    query = stream.writeStream.foreachBatch(lambda df, _: said.append(df.collect())).outputMode("update").option("checkpointLocation", place).trigger(availableNow=True).start()
    ended = query.awaitTermination(90)
    query.stop()
    assert ended and query.exception() is None
    return said


def latest(said, memory):
    """Memory after batches: a batch replaces what was kept of its conversations."""
    for batch in said:
        for conv in {r.conv_id for r in batch}:
            memory[conv] = [(r.turn, r.role, r.text) for r in sorted((r for r in batch if r.conv_id == conv), key=lambda r: r.place)]
    return memory


def test_stream_equals_table_over_restarts(stored, tmp_path):
    rows = stored.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").where("conv_id < 8")
    source, place = str(tmp_path / "turns"), str(tmp_path / "state")
    rows.where("turn % 3 <> 1").coalesce(1).write.parquet(source)
    memory = latest(consumed(stored, source, place), {})
    rows.where("turn % 3 = 1").coalesce(1).write.mode("append").parquet(source)  # late turns among them
    stored.createDataFrame([(None, 1, "user", "x"), (3, None, "user", "y")], TURNS).coalesce(1).write.mode("append").parquet(source)
    memory = latest(consumed(stored, source, place), memory)
    want = {}
    for r in last_messages(rows).orderBy("turn").collect():
        want.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert memory == want and len(want) > 3
    assert consumed(stored, source, place) == []  # nothing new, nothing said


def test_conversations_are_forgotten(stored, tmp_path):
    source, place = str(tmp_path / "turns"), str(tmp_path / "state")
    stored.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b")], TURNS).coalesce(1).write.parquet(source)
    assert latest(consumed(stored, source, place, forget=2), {}) == {1: [(1, "user", "a"), (2, "assistant", "b")]}
    time.sleep(3)
    stored.createDataFrame([(1, 3, "user", "c")], TURNS).coalesce(1).write.mode("append").parquet(source)
    assert latest(consumed(stored, source, place, forget=2), {}) == {1: [(3, "user", "c")]}
