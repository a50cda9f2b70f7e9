"""Operators on larger tables: no limits on recursion, no broadcasts of what grows, tasks that stay small."""

import pytest
from pyspark.sql import functions as F


from lamella import session
from lamella.operators import diffs, intervals, revisions, scheduling, spatial, trees


@pytest.fixture
def few_rows(spark):
    """Recursion in SQL stops with an error beyond so many rows, whatever a table's size; the default is 1,000,000."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    yield
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_closure_has_no_limit_of_rows(spark, few_rows):
    need = spark.createDataFrame([(k, None if k in (1, 50) else k % 3 > 0) for k in range(60)], "id long, direct boolean")
    on = spark.createDataFrame([(k, k // 2) for k in range(2, 60)] + [(k, k // 7) for k in range(14, 60)] + [(1, 1)], "id long, on long")
    below: dict = {k: {k} for k in range(60)}
    for k in range(2, 60):
        below[k] |= below[k // 2] | (below[k // 7] if k >= 14 else set())
    state = {r.id: r.direct for r in need.collect()}
    want = set()
    for k, of in below.items():
        lost = sorted(x for x in of if state[x] is False)
        want.add((k, not lost if any(state[x] is not None for x in of) else None, len(lost), lost[0] if lost else None))
    assert {tuple(r) for r in trees.dependency_closure(need, on).collect()} == want


def test_references_have_no_limit_of_rows(spark, few_rows):
    refs = spark.createDataFrame([(k, k - 1 if k else None) for k in range(40)] + [(50, 51), (51, 50), (60, 99), (61, 61)], "id long, next long")
    got = {r.id: (r.hops, r.last, r.outcome) for r in revisions.follow_references(refs, 16).collect()}
    assert got[0] == (0, 0, "resolved") and got[16] == (16, 0, "resolved") and got[17] == (16, 1, "depth") and got[39] == (16, 23, "depth")
    assert got[50] == (1, 51, "cycle") and got[60] == (0, 60, "missing") and got[61] == (0, 61, "cycle") and len(got) == 44


def test_pointers_are_not_broadcast(spark):
    """Neither are nodes without a pointer one key of a join."""
    nodes = session.kept(spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") + 1).alias("up")))
    met = trees._met(nodes, nodes.withColumn("known", F.lit(True)), "known")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "_alone" in plan.split("hashpartitioning(", 1)[1].split(")")[0]
    assert met.where("above_known").count() == 100 and met.count() == 1000


def test_equal_rectangles_meet_once(spark, monkeypatch):
    a = spark.range(200).select(F.col("id").alias("a"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(9).alias("x1"), (F.col("id") % 2 * 9).alias("y1"))
    b = spark.range(300).select(F.col("id").alias("b"), F.lit(5).alias("x0"), F.lit(5).alias("y0"), F.lit(20).alias("x1"), F.lit(20).alias("y1"))
    sizes, real = [], spatial.overlap_join
    monkeypatch.setattr(spatial, "overlap_join", lambda x, y, s: sizes.append((x.count(), y.count())) or real(x, y, s))
    got = {tuple(r) for r in spatial.overlap_counts(a, b, "a", "b", 8).collect()}
    assert got == {(k, 300, 0, 299) for k in range(1, 200, 2)} and sizes == [(2, 1)]


def test_tasks_of_ranges_stay_small(spark, monkeypatch):
    """Tasks grow in number with the rows, beyond the number of shuffle partitions."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = spark.range(2000).select((F.col("id") % 50).alias("k"), F.col("id").alias("s"), (F.col("id") + 2).alias("e"), F.lit(1).alias("p"))
    for out in (intervals.coalesce_ranges(rows, ["k"], "s", "e", "p", 5), intervals.gaps(rows, ["k"], "s", "e")):
        assert out.rdd.getNumPartitions() == 21
    assert intervals.gaps(rows, ["k"], "s", "e").count() == 50 * 39


def test_sections_meet_where_they_are(spark):
    """Lists dealt by their keys alike are compared without a join, and not dealt again."""
    rows = spark.range(400).select((F.col("id") % 20).alias("k"), F.floor(F.col("id") / 20).alias("i"), (F.col("id") % 7).alias("v"))
    side = lambda d: d.repartition(6, "k")
    out = diffs.section_diff(side(rows), side(rows.where("i <> 3").withColumn("v", F.when(F.col("i") == 5, None).otherwise(F.col("v")))), ["k"], "i", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert {tuple(r)[1:] for r in out.collect()} == {(20, 19, 1, 1, 0, 3)}


def test_queues_are_arrays(spark):
    """A worker's queue is no Python object for each request."""
    queue = spark.range(100).select((F.col("id") % 3).alias("w"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("s"), (-F.col("id")).alias("n"))
    out = scheduling.dispatched(queue, "w", "s", ["n"], 2)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.w, r.position) for r in out.collect()} == {(w, k + 1) for w in range(3) for k in range(34 - (w > 0))}


def test_equal_programs_are_read_once(spark, monkeypatch):
    """Over batches too; pages without content give no rows, and what is held is bounded."""
    import pyarrow as pa

    from lamella.operators import content

    read, real, run = [], content.commands, []
    monkeypatch.setattr(content, "commands", lambda data: read.append(data) or real(data))
    plain = type("D", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, f, s: run.append(f)})()
    content.page_commands(plain)
    batch = pa.record_batch({"page": pa.array([1, 2, 3, 4, 5]), "content": pa.array([b"0 0 5 5 re f", b"q", b"0 0 5 5 re f", None, b"q"], pa.binary())})
    got = [tuple(r.values()) for out in run[0]([batch, batch]) for r in out.to_pylist()]
    assert len(read) == 2 and len(got) == 8 and [r[0] for r in got[:4]] == [1, 2, 3, 5] and [r[-1] for r in got[:4]] == ["ready", "unclosed", "ready", "unclosed"]
    monkeypatch.setattr(content, "HELD", 1)
    assert [tuple(r.values()) for out in run[0]([batch, batch]) for r in out.to_pylist()] == got
