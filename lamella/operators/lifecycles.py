"""Requests on held ranges, decisions between signals, ordered folds of layers, commands on tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_point as fx
from .intervals import coalesce_ranges
from .spatial import tiles


def poll_ranges(requests: DataFrame, held: DataFrame, key: str, length: int, cell: int) -> DataFrame:
    """What a store of ranges says to each request (key, request, start, end; half-open): 'eof' past the length, 'ready', or 'pending' with the bytes missing.

    Held ranges (key, s, e) may overlap. Both sides are cut at cells before they meet, so a request meets the ranges of its cells alone.
    """
    def cut(d: DataFrame, start: str, end: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col(start) / cell).cast("long"), F.floor((F.col(end) - 1) / cell).cast("long"))
        whole = d.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(cells))
        return whole.withColumn(start, F.greatest(F.col(start), F.col("_cell") * cell)).withColumn(end, F.least(F.col(end), (F.col("_cell") + 1) * cell))

    merged = coalesce_ranges(held.withColumn("_p", F.lit(0)), [key], "s", "e", "_p", 0).select(key, F.col("merged_start").alias("s"), F.col("merged_end").alias("e"))
    asked = requests.withColumn("_end", F.least("end", F.lit(length)))
    met = cut(asked.select(key, "request", F.col("start").alias("_from"), F.col("_end").alias("_to")), "_from", "_to").join(cut(merged, "s", "e"), [key, "_cell"])
    covered = met.groupBy(key, "request").agg(F.sum(F.greatest(F.lit(0), F.least("_to", "e") - F.greatest("_from", "s"))).alias("_covered"))
    missing = F.col("_end") - F.col("start") - F.coalesce("_covered", F.lit(0))
    out = asked.join(covered, [key, "request"], "left").withColumn("missing", F.greatest(missing, F.lit(0)).cast("long"))
    status = F.when(F.col("start") >= length, "eof").when(F.col("missing") == 0, "ready").otherwise("pending")
    return out.withColumn("status", status).drop("_end", "_covered")


def arbitrate(events: DataFrame, work: str, order: str, action: str) -> DataFrame:
    """A decision on each signal of a work: its first start counts, then the first of 'cancel', 'fail' and 'complete'; what comes before, again or later changes nothing."""
    all_of = Window.partitionBy(work)
    is_start = F.col(action) == "start"
    begun = events.withColumn("_begun", F.min(F.when(is_start, F.col(order))).over(all_of))
    ended = begun.withColumn("_ended", F.min(F.when(~is_start & (F.col(order) > F.col("_begun")), F.col(order))).over(all_of))
    start = F.when(F.col(order) == F.col("_begun"), "started").otherwise("duplicate")
    signal = F.when(F.col("_begun").isNull() | (F.col(order) < F.col("_begun")), "unknown").when(F.col(order) == F.col("_ended"), "accepted").otherwise("late")
    return ended.withColumn("decision", F.when(is_start, start).otherwise(signal)).drop("_begun", "_ended")


def composite(layers: DataFrame, key: str, order: str) -> DataFrame:
    """Layers (key, order, c, a, opacity in 65536ths, c premultiplied; knockout) one over the other, by key, and the result in bytes.

    A knockout replaces what it covers by its shape before opacity. Rounding makes the fold depend on the order, so a key's layers are folded as one array.
    """
    zero = F.lit(0).cast("long")
    mix = lambda s, prior, shape: F.floor((s * fx.ONE + prior * (fx.ONE - shape) + fx.ONE // 2) / fx.ONE).cast("long")

    def step(state, x):
        shape = F.when(x["knockout"], x["a"]).otherwise(fx.multiply(x["a"], x["opacity"]))
        return F.struct(*(mix(fx.multiply(x[n], x["opacity"]), state[n], shape).alias(n) for n in ("c", "a")))

    stack = F.array_sort(F.collect_list(F.struct(order, "c", "a", "opacity", "knockout")))
    top = layers.groupBy(key).agg(stack.alias("_l")).withColumn("_t", F.aggregate("_l", F.struct(zero.alias("c"), zero.alias("a")), step))
    c, a = F.col("_t.c"), F.col("_t.a")
    straight = F.when(a > 0, F.least(F.lit(fx.ONE), F.floor((c * fx.ONE + F.floor(a / 2)) / a))).otherwise(F.lit(0))
    byte = lambda v: F.floor((v * 255 + fx.ONE // 2) / fx.ONE).cast("long")
    return top.select(key, F.size("_l").alias("layers"), c.alias("c"), a.alias("a"), byte(straight).alias("color_byte"), byte(a).alias("alpha_byte"))


def tile_commands(commands: DataFrame, size: int, columns: int, rows: int) -> DataFrame:
    """Every (tile, command): one that changes state belongs to every tile of the grid, a visible one to those its bounds meet."""
    grid = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    state = commands.where("is_state").withColumn("tx", grid(columns)).withColumn("ty", grid(rows))
    seen = tiles(commands.where("not is_state"), size).where((F.col("tx") < columns) & (F.col("ty") < rows))
    return state.unionByName(seen)


#: What each action does to a surface in each state: the next state and the outcome. Anything else leaves the state as it is.
SURFACE = {
    ("none", "allocate"): ("private", "done"),
    ("private", "write"): ("written", "done"),
    ("written", "write"): ("written", "done"),
    ("private", "publish"): ("private", "incomplete"),
    ("written", "publish"): ("available", "done"),
    ("available", "transfer"): ("transferred", "done"),
    ("transferred", "transfer"): ("transferred", "consumed"),
    ("imported", "transfer"): ("imported", "consumed"),
    ("available", "import"): ("available", "consumed"),
    ("transferred", "import"): ("imported", "done"),
    ("imported", "import"): ("imported", "consumed"),
    ("available", "acquire"): ("available", "handle"),
    ("transferred", "acquire"): ("transferred", "handle"),
    ("imported", "acquire"): ("imported", "done"),
    ("released", "release"): ("released", "already-released"),
    **{(state, action): ("released", "done") for action in ("release", "close") for state in ("private", "written", "available", "transferred", "imported")},
    **{(state, "expire"): ("released", "done") for state in ("available", "transferred", "imported")},
}


def automaton(events: DataFrame, key: str, order: str, action: str, moves: dict[tuple[str, str], tuple[str, str]], start: str, refused: str) -> DataFrame:
    """(key, order, action, state, outcome) of each event: the state of its key after it by the table of moves, or the state as it was and `refused`.

    The events of one key are folded as one array: keys are things with a short life, such as surfaces, not sessions.
    """
    table = F.create_map(*(F.lit(x) for (state, act), (after, outcome) in moves.items() for x in (f"{state}|{act}", f"{after}|{outcome}")))

    def step(s, x):
        move = F.coalesce(F.try_element_at(table, F.concat(s["at"], F.lit("|"), x[action])), F.concat(s["at"], F.lit(f"|{refused}")))
        after = F.split_part(move, F.lit("|"), F.lit(1))
        done = F.struct(x[order].alias(order), x[action].alias(action), after.alias("state"), F.split_part(move, F.lit("|"), F.lit(2)).alias("outcome"))
        return F.struct(after.alias("at"), F.concat(s["log"], F.array(done)).alias("log"))

    kind = dict(events.dtypes)
    empty = F.array().cast(f"array<struct<{order}:{kind[order]},{action}:string,state:string,outcome:string>>")
    begin = F.struct(F.lit(start).alias("at"), empty.alias("log"))
    told = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, action))).alias("_e"))
    return told.select(key, F.inline(F.aggregate("_e", begin, step, lambda s: s["log"])))
