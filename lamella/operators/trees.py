"""Trees of rows (id, parent): inheritance, subtree counts, visibility, outcomes; dependency closure.

Pointers double: after round k a node points 2^k levels up and holds what lies
in between, so a tree of depth d takes log2(d) rounds of one join each, whatever its shape.
Rounds end when no pointer is left, or after more doublings than there are nodes: what then still points lies on or under a cycle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept


def _doubled(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state (id, up, ...) after so many steps that up is null everywhere but on and under cycles."""
    state = kept(state)
    rounds = state.count().bit_length() + 1
    while rounds and not state.where("up is not null").isEmpty():
        state, rounds = kept(step(state)), rounds - 1
    return state


def _met(state: DataFrame, above: DataFrame, *columns: str) -> DataFrame:
    """The state beside what its pointers point to in above (id, ...): above_<column>, null where they point at nothing.

    Nothing is broadcast, as a table's files are small beside its rows; and nodes without a pointer do not meet in one task.
    """
    alone = F.when(F.col("up").isNull(), F.pmod(F.xxhash64("id"), F.lit(4096))).otherwise(0).alias("_alone")
    to = above.select(F.col("id").alias("up"), F.when(F.col("id").isNull(), 1).otherwise(0).cast("long").alias("_alone"), *(F.col(c).alias(f"above_{c}") for c in columns))
    return state.select("*", alone.cast("long").alias("_alone")).join(to.hint("merge"), ["up", "_alone"], "left").drop("_alone")


def inherited(nodes: DataFrame, value: str) -> DataFrame:
    """(id, value, distance): the value of the nearest node at or above that has one; null if none has. On a cycle the nearest one around it counts."""
    own = F.when(F.col(value).isNull(), F.col("parent"))
    state = nodes.select("id", own.alias("up"), F.col(value).alias("v"), F.when(F.col(value).isNotNull(), 0).alias("d"), F.lit(1).alias("span"))

    def step(s: DataFrame) -> DataFrame:
        j = _met(s, s.withColumn("next", F.col("up")).withColumn("known", F.lit(True)), "next", "v", "d", "span", "known")
        # a node with a value above it is done; so is one that points at nothing
        going = F.col("up").isNotNull() & F.col("above_known").isNotNull()
        done = going & F.col("above_d").isNotNull()
        return j.select(
            "id", F.when(going & ~done, F.col("above_next")).alias("up"), F.when(done, F.col("above_v")).otherwise(F.col("v")).alias("v"),
            F.when(done, F.col("span") + F.col("above_d")).otherwise(F.col("d")).alias("d"), F.when(going, F.col("span") + F.col("above_span")).otherwise(F.col("span")).alias("span"),
        )

    return _doubled(state, step).select("id", F.col("v").alias(value), F.col("d").alias("distance"))


def _gathered(state: DataFrame, given, further) -> DataFrame:
    """One round of sums: n grows by what the nodes that point here give; pointers go on where `further` (of above_ columns) allows."""
    more = state.where("up is not null").groupBy("up").agg(F.sum(given).alias("more")).withColumnRenamed("up", "id")
    j = state.join(more.hint("merge"), "id", "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).drop("more")
    j = _met(j, state.withColumn("next", F.col("up")), "next", *(c for c in state.columns if c not in ("id", "up", "n"))).withColumn("up", F.when(further, F.col("above_next")))
    return j.select(*state.columns)


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """(id, leaves, declared, ok) of inner nodes of (id, parent, is_leaf, declared). Counts on a cycle mean nothing: see outcomes."""
    state = nodes.select("id", F.col("parent").alias("up"), F.col("is_leaf").cast("long").alias("n"))
    counted = _doubled(state, lambda s: _gathered(s, F.col("n"), F.lit(True))).select("id", F.col("n").alias("leaves"))
    return nodes.where("not is_leaf").join(counted, "id").select("id", "leaves", "declared", (F.col("leaves") == F.col("declared")).alias("ok"))


def visible_descendants(nodes: DataFrame) -> DataFrame:
    """(id, visible): descendants of (id, parent, open) that show when the node is opened: all nodes between are open."""
    state = nodes.select("id", F.col("parent").alias("up"), F.lit(0).cast("long").alias("n"), F.col("open").cast("boolean").alias("open"))
    given = F.when(F.col("open"), F.col("n") + 1).otherwise(1)
    return _doubled(state, lambda s: _gathered(s, given, F.col("above_open"))).select("id", F.col("n").alias("visible"))


def outcomes(nodes: DataFrame) -> DataFrame:
    """(id, outcome, depth) of (id, parent): root with its distance if the way up ends, missing if it ends at a parent that is no node, cycle (no depth) if it never ends."""
    state = nodes.select("id", F.col("parent").alias("up"), F.lit(0).alias("d"), F.lit(1).alias("span"), F.lit("root").alias("end"))

    def step(s: DataFrame) -> DataFrame:
        j = _met(s, s.withColumn("next", F.col("up")).withColumn("known", F.lit(True)), "next", "d", "span", "end", "known")
        at = F.col("up").isNotNull()
        lost = at & F.col("above_known").isNull()
        ended = at & ~lost & F.col("above_next").isNull()
        return j.select(
            "id", F.when(at & ~lost, F.col("above_next")).alias("up"),
            F.when(lost, F.col("span") - 1).when(ended, F.col("span") + F.col("above_d")).otherwise(F.col("d")).alias("d"),
            F.when(at & ~lost, F.col("span") + F.col("above_span")).otherwise(F.col("span")).alias("span"),
            F.when(lost, F.lit("missing")).when(ended, F.col("above_end")).otherwise(F.col("end")).alias("end"),
        )

    end = F.when(F.col("up").isNotNull(), "cycle").otherwise(F.col("end"))
    return _doubled(state, step).select("id", end.alias("outcome"), F.when(F.col("up").isNull(), F.col("d")).alias("depth"))


def _reaching(start: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Distinct (id, on_id) of start and of all that depend on an id of it, in rounds of one join each; a round goes on from new pairs alone."""
    below = kept(dependencies.select(F.col("on").alias("_on"), F.col("id").alias("_id")).distinct())
    new = found = kept(start.select("id", "on_id").distinct())
    while not new.isEmpty():
        met = new.join(below.hint("merge"), F.col("id") == F.col("_on")).select(F.col("_id").alias("id"), "on_id").distinct()
        new = kept(met.join(found.hint("merge"), ["id", "on_id"], "left_anti"))
        found = found.unionAll(new)
    return found


def dependency_closure(requirements: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(id, supported, n_missing, first_missing) of requirements (id, direct) over all they depend on (dependencies: id, on).

    The ways are gone from what is missing up to what needs it, so only pairs that count are made.
    """
    requirements = kept(requirements.select("id", "direct"))
    missing = requirements.where("not direct").groupBy("id").agg(F.count("*").alias("_n"))
    pairs = _reaching(missing.select("id", F.col("id").alias("on_id")), dependencies)
    lost = pairs.join(missing.withColumnRenamed("id", "on_id"), "on_id").groupBy("id").agg(F.sum("_n").alias("n_missing"), F.min("on_id").alias("first_missing"))
    own = requirements.select("id").distinct()
    supported = F.col("n_missing") == 0
    if not requirements.where("direct is null").isEmpty():
        # where nothing is known of all that is needed, neither is the whole
        told = _reaching(requirements.where("direct is not null").select("id", F.lit(0).alias("on_id")), dependencies).select("id", F.lit(True).alias("_told"))
        own, supported = own.join(told, "id", "left"), F.when(F.col("_told"), supported)
    out = own.join(lost, "id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    return out.select("id", supported.alias("supported"), "n_missing", "first_missing")
