"""How many tasks and rounds small tables take."""

from umbra.llm import components as components_module
from umbra.llm.common import written
from umbra.llm.components import components
from umbra.llm.substring_dedup import without_repeats


def test_few_rows_take_few_tasks(spark):
    """Tasks follow the rows, not the number of shuffle partitions: each costs the driver memory and time."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 90), (91, 90), (200, 201)], "u long, v long")
        context.setJobGroup("few tasks", "")
        got = {r.node: r.component for r in components(edges).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {i: 0 for i in (*range(41), 90, 91)} | {200: 200, 201: 200}
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
    wide = [n.numTasks for n in map(tracker.getStageInfo, stages) if n and n.numTasks >= 64]
    assert len(wide) <= 4  # those before the edges are counted, or skipped


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already are not contracted to see that nothing changes."""
    tables = []
    monkeypatch.setattr(components_module, "written", lambda df: tables.append(1) or written(df))
    edges = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, 21)], "u long, v long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(9)} | {(20, 20), (21, 20)}
    assert len(tables) == 1


def test_table_of_names_comes_in_few_jobs(spark, monkeypatch):
    """The driver fetches the table of repeated names partition by partition, and each is a job."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"x {text}")], "doc_id long, text string")
    parts, kind = [], type(docs)
    fetch = kind.toLocalIterator
    monkeypatch.setattr(kind, "toLocalIterator", lambda self: parts.append(self.rdd.getNumPartitions()) or fetch(self))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.n_removed for r in without_repeats(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {1: 0, 2: 60}
    assert parts and max(parts) <= max(8, spark.sparkContext.defaultParallelism) + 1
