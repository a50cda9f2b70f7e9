"""Edges of folds and of the table of moves that the given tables do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from lamella.functions import blend, characters
from lamella.operators import lifecycles, scheduling


def test_transparent_layers(spark):
    rows = [(1, 1, 0, 0, 65536, False), (2, 1, 65536, 65536, 65536, False), (2, 2, 0, 65536, 0, True)]
    out = lifecycles.composite(spark.createDataFrame(rows, "k long, n long, c long, a long, opacity long, knockout boolean"), "k", "n")
    assert {r.k: (r.color_byte, r.alpha_byte) for r in out.collect()} == {1: (0, 0), 2: (0, 0)}


def test_modes_at_the_edges(spark):
    clear, solid = (9, 8, 7, 0), (10, 20, 30, 255)
    rows = spark.createDataFrame([(m, *s, *d) for m in (*blend.MODES, "none") for s in (clear, solid) for d in (clear, solid)], "mode string, sr long, sg long, sb long, sa long, dr long, dg long, db long, da long")
    got = {(r.mode, r.sa, r.da): (r.r, r.g, r.b, r.a) for r in blend.blended(rows, "mode").collect()}
    assert all(got[m, 0, 0] == (0, 0, 0, 0) for m in blend.MODES) and got["none", 0, 0] == (None,) * 4
    assert got["source_over", 255, 0] == solid and got["screen", 0, 255] == solid and got["luminosity", 255, 255] == solid and len(blend.MODES) == 29


def test_moves(spark):
    acts = ["write", "allocate", "publish", "write", "publish", "transfer", "transfer", "import", "acquire", "close", "release", "write"]
    out = lifecycles.automaton(spark.createDataFrame(list(enumerate(acts)), "n long, act string").withColumn("k", F.lit(1)), "k", "n", "act", lifecycles.SURFACE, "none", "refused").orderBy("n")
    assert [r.outcome for r in out.collect()] == ["refused", "done", "incomplete", "done", "done", "done", "consumed", "done", "done", "done", "already-released", "refused"]


def test_scalars_and_codes(spark):
    texts = ["1", "+.5", "-5.", "", ".", "1e3", "9223372036.854775807", "9223372036.854775808", "-9223372036.854775808", "0.0000000001", "9" * 40, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [None if r[0] is None else int(r[0]) for r in rows.select(characters.scene_scalar(F.col("t"))).collect()]
    assert got == [10**9, 5 * 10**8, -5 * 10**9, None, None, None, 2**63 - 1, None, -(2**63), None, None, None]
    one = spark.range(1).select(characters.name_hash(F.encode(F.lit(""), "UTF-8")).alias("e"), characters.name_hash(F.encode(F.lit("a"), "UTF-8")).alias("a"), characters.winansi(F.unhex(F.lit("80A0AD7F"))).alias("w"), characters.winansi(F.unhex(F.lit("41001F"))).alias("x")).first()
    assert (int(one.e), int(one.a), one.w, one.x) == (0xCBF29CE484222325, 0xAF63DC4C8601EC8C, "€ -•", None)


def slowly(waiting, burst):
    """The rule as it reads: all sessions with work are looked at before each turn."""
    left, last, out = {s: list(enumerate(k)) for s, k in waiting.items()}, dict.fromkeys(waiting, 0), []
    while any(left.values()):
        least = min(last[s] for s in left if left[s])
        s = min((s for s in left if left[s] and last[s] < least + burst), key=lambda s: left[s][0][1])
        out.append((len(out) + 1, s, left[s].pop(0)[0]))
        last[s] = len(out)
    return out


@pytest.mark.parametrize("burst", [1, 2, 4, 50])
def test_turns(burst):
    for seed in range(40):
        r = random.Random(seed)
        keys = r.sample(range(1000), r.randint(1, 60))
        waiting: dict = {}
        for k in sorted(keys):
            waiting.setdefault(r.randint(1, 7), []).append((k,))
        assert scheduling._turns(waiting, burst) == slowly(waiting, burst)


def test_dispatched(spark):
    rows = [(0, 1, n) for n in range(6)] + [(0, 2, 10 + n) for n in range(2)] + [(1, 3, 5)]
    out = scheduling.dispatched(spark.createDataFrame(rows, "w long, s long, n long"), "w", "s", ["n"], 3)
    # at turn 4 session 1 was served at 3, not below 0 + 3; at turn 7 at 6, below 4 + 3
    assert [(r.s, r.n) for r in out.where("w = 0").orderBy("position").collect()] == [(1, 0), (1, 1), (1, 2), (2, 10), (1, 3), (1, 4), (1, 5), (2, 11)]
    assert scheduling.dispatched(out.where("w > 5"), "w", "s", ["n"], 3).count() == 0
