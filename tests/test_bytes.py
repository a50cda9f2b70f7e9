"""Decoders, syntax, page programs, caches and streams on literal cases."""

import base64
import zlib

import pytest

from lamella.functions import codecs as c
from lamella.operators import content
from lamella.sources import syntax as s


def test_filters():
    data = bytes(range(256)) + b"\0" * 8
    a85 = base64.a85encode(data) + b"~>"
    assert c.decode(a85, ["ASCII85Decode"], 1000) == data
    assert c.decode(zlib.compress(data).hex().encode() + b" >", ["ASCIIHexDecode", "FlateDecode"], 1000) == data
    assert c.run_length(b"\x02abc\xfex\x80", 100) == b"abcxxx"
    assert c.ascii_hex(b"4 1 4>", 10) == b"A@"
    for f, x, code in ((c.ascii_hex, b"41", "hex-no-end"), (c.ascii_hex, b"4G>", "hex-digit"), (c.run_length, b"\x05ab\x80", "rl-short"), (c.flate, zlib.compress(data)[:-3], "flate-short"), (c.ascii85, b"!~>", "a85-single"), (c.ascii85, b"uuuuu~>", "a85-range")):
        with pytest.raises(c.DecodeError, match=code):
            f(x, 1000)
    with pytest.raises(c.DecodeError, match="output-limit"):
        c.flate(zlib.compress(b"x" * 100), 99)


def test_predictors():
    assert c.png_rows(bytes([0, 1, 2, 3, 1, 1, 1, 1, 2, 1, 1, 1, 4, 1, 1, 1, 3, 2, 2, 2]), 3) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 4, 5, 3, 5, 7])
    assert c.tiff_rows(bytes([1, 1, 1, 5, 1, 1]), 3) == bytes([1, 2, 3, 5, 6, 7])
    with pytest.raises(c.DecodeError, match="png-kind"):
        c.png_rows(b"\x05a", 1)


def test_strings():
    assert c.text_string(b"\xfe\xff\x00A\xd8\x3d\xde\x00") == "A\U0001f600"
    assert c.text_string(b"A\x80\xa0\xe9") == "A•€é"
    with pytest.raises(c.DecodeError, match="text-utf16"):
        c.text_string(b"\xfe\xff\xd8\x00\x00A")
    with pytest.raises(c.DecodeError, match="text-undefined"):
        c.text_string(b"\x01")
    assert c.name_token(b"/A#20B") == b"A B"
    assert c.literal_string(b"(a\\(b\\)\\101\\\n(c)\r\n)") == b"a(b)A(c)\n"


def test_objects():
    d = s.direct_object(b"<< /Type /Page /Kids [1 0 R 2 0 R] /N 1.50 /N 7 /S (x) >>")
    assert s.field(d, "N") == 7 and s.field(d, "Kids") == [{"ref": [1, 0]}, {"ref": [2, 0]}]
    with pytest.raises(s.DecodeError, match="duplicate-key"):
        s.field(d, "N", unique=True)
    with pytest.raises(s.DecodeError, match="unclosed"):
        s.direct_object(b"[1 2")
    assert s.header_version(b"%PDF-1.7\n") == (1, 7)


def test_cross_reference():
    table = b"xref\n0 2\n0000000000 65535 f \n0000000015 00000 n \n4 1\n0000000099 00002 n \ntrailer"
    assert list(s.xref_table(table, 0)) == [(0, 65535, "free", 0), (1, 0, "in-use", 15), (4, 2, "in-use", 99)]
    assert s.anchor_kind(table, 0) == "table" and s.anchor_kind(b"12 0 obj", 0) == "stream"
    assert s.final_anchor(b"x startxref\n12\n%%EOF startxref\n345\n%%EOF\n") == 345
    assert list(s.xref_stream_rows(bytes([1, 0, 16, 0, 2, 0, 5, 3]), [1, 2, 1], [7, 2])) == [(7, 1, 16, 0), (8, 2, 5, 3)]
    assert [(i, n, x.strip()) for i, n, x in s.object_stream(b"11 0 12 3 5  [1]", 2, 10)] == [(0, 11, b"5"), (1, 12, b"[1]")]


def test_page_program():
    rows = content.commands(b"q 2 0 0 2 10 20 cm 1 1 3 4 re f* Q BT /F1 12 Tf 5 5 Td (hi) Tj 0 -14 TD T* [(a) 3 (b)] TJ ET 0 0 m 9 9 l S")
    assert [(r["kind"], r["fill"], r["stroke"]) for r in rows] == [("save", 0, 0), ("paint", 2, 0), ("restore", 0, 0), ("glyphs", 0, 0), ("glyphs", 0, 0), ("paint", 0, 1)]
    u = content.UNIT
    assert (rows[1]["x0"], rows[1]["y0"], rows[1]["x1"], rows[1]["y1"]) == (12 * u, 22 * u, 18 * u, 30 * u)
    assert (rows[3]["x0"], rows[3]["y0"]) == (5 * u, 5 * u) and rows[4]["y0"] == -23 * u
    for bad, code in ((b"Q", "unbalanced"), (b"q", "unclosed"), (b"1 w 2 3 w", "operand-count"), (b"(x) Tj", "text-object"), (b"1 zz", "unknown-operator"), (b"1 2", "dangling")):
        with pytest.raises(c.DecodeError, match=code):
            content.commands(bad)
    assert content.commands(b"BX 1 zz EX") == [] and len(content.ARITY) == 66


def test_lru_by_bytes(spark):
    from lamella.operators.scheduling import lru

    df = spark.createDataFrame([(1, i, k, w) for i, (k, w) in enumerate([("a", 4), ("b", 4), ("a", 4), ("c", 4), ("b", 4), ("d", 99), ("a", 4)])], "p long, s long, k string, w long")
    got = [(r.hit, r.evicted, r.held) for r in lru(df, "p", "s", "k", "w", 9, 10).orderBy("s").collect()]
    assert got == [(False, 0, 4), (False, 0, 8), (True, 0, 8), (False, 1, 8), (False, 1, 8), (False, 0, 8), (False, 1, 8)]


def test_coalescing_boundaries(spark):
    from lamella.operators.intervals import coalesce_ranges

    def merged(rows, gap):
        df = spark.createDataFrame([(0, a, a + n, 1) for a, n in rows], "k long, s long, e long, p long")
        return sorted((r.merged_start, r.merged_end) for r in coalesce_ranges(df, ["k"], "s", "e", "p", gap).collect())

    # a gap of one less than the threshold joins, the threshold itself does not
    assert merged([(105, 10), (300, 1), (90, 12), (119, 6)], 5) == [(90, 125), (300, 301)]
    assert merged([(1, 9), (17, 3)], 7) == [(1, 10), (17, 20)] and merged([(1, 9), (17, 3)], 8) == [(1, 20)]
    # with no threshold neighbours stay apart, overlaps do not
    assert merged([(33, 7), (40, 7)], 0) == [(33, 40), (40, 47)] and merged([(33, 8), (40, 7)], 0) == [(33, 47)]


def test_nearest_rank(spark):
    from lamella.operators.statistics import sample_summary

    df = spark.createDataFrame([("n", 3 * v) for v in range(40)] + [("s", v) for v in (7, 31, 2)], "k string, v long")
    got = {r.k: (r.min_v, r.p50, r.p95, r.p99, r.max_v, r.adequacy) for r in sample_summary(df, ["k"], "v", 6).collect()}
    assert got == {"n": (0, 57, 111, 117, 117, "meets-configured-minimum"), "s": (2, 7, 31, 31, 31, "insufficient")}


def test_generation_stream(spark, tmp_path):
    from lamella.streaming.windows import generation_stream

    spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, "d")], "session long, generation long, payload string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session long, generation long, payload string").parquet(str(tmp_path / "in"))
    q = generation_stream(stream, "session", "generation", "payload").writeStream.format("memory").queryName("gen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.payload, r.decision) for r in spark.table("gen").collect()}
    assert got == {("a", "publish"), ("b", "publish"), ("c", "discard-stale"), ("d", "publish")}


def test_artifacts(spark):
    import hashlib

    from pyspark.sql import functions as F

    from lamella.sources import artifacts as a

    digest = hashlib.sha256(b"x").hexdigest()
    text = f'[[entry]]\nsha256 = "{digest}"\npath = "a.pdf"\ntier = "T1"\npage_count = 3\nlicense_expression = "MIT"\nfeatures = ["b", "a", "b"]\n'
    entries = a.manifest(spark, text)
    assert entries.first().features == ["a", "b"] and a.manifest_lines(entries).first().line.startswith('{"sha256"')
    objects = spark.createDataFrame([("a.pdf", b"y")], "path string, content binary")
    assert a.verify(entries, objects).first().outcome == "mismatch"
    line = a.pixel_line(1, 2, b"\1\2\3\4\5\6\7\x08")
    got = spark.createDataFrame([(line,), ('{"width":1,"height":1,"rgba_hex":"00"}',)], "s string").select(a.pixels(F.col("s")).alias("p")).collect()
    assert bytes(got[0].p.rgba) == b"\1\2\3\4\5\6\7\x08" and got[1].p is None
    assert a.png(1, 2, b"\1\2\3\4\5\6\7\x08")[:8] == b"\x89PNG\r\n\x1a\n"


def test_segmented_cache(spark):
    from lamella.operators.scheduling import segmented

    df = spark.createDataFrame([(1, i, k, v) for i, (k, v) in enumerate([(10, 0), (11, 1), (12, 1), (13, 1), (11, 1)])], "p long, s long, k long, v long")
    assert [(r.hit, r.evicted) for r in segmented(df, "p", "s", "k", "v", 3).orderBy("s").collect()] == [(False, None), (False, None), (False, None), (False, 10), (True, None)]


def test_bytes_after_the_end():
    import base64
    import zlib

    from lamella.functions.codecs import DecodeError, ascii85, ascii_hex, flate, run_length

    whole = [(ascii_hex, b"41 42>"), (run_length, b"\x01AB\x80"), (flate, zlib.compress(b"AB")), (ascii85, base64.a85encode(b"AB") + b"~>")]
    for f, data in whole:
        assert f(data, 100) == b"AB"
        try:
            f(data + b"x", 100)
        except DecodeError as e:
            assert str(e) == "trailing-data"
        else:
            raise AssertionError(f)
    assert ascii_hex(b"4142> \n\x00", 9) == b"AB"


def test_deep_trees_and_cycles(spark):
    from pyspark.sql import functions as F

    from lamella.operators import trees

    n = 1000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), (F.col("id") == n - 1).alias("is_leaf"), F.lit(1).alias("declared"), (F.col("id") != 500).alias("open"), F.when(F.col("id") == 3, 7).alias("v"))
    assert trees.subtree_counts(chain).where("ok").count() == n - 1
    seen = {r.id: r.visible for r in trees.visible_descendants(chain).collect()}
    assert seen == {i: (500 - i if i < 500 else n - 1 - i) for i in range(n)}
    got = {r.id: (r.v, r.distance) for r in trees.inherited(chain, "v").collect()}
    assert got == {i: ((7, i - 3) if i >= 3 else (None, None)) for i in range(n)}
    odd = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None), (5, 4), (6, 99), (7, 6), (8, 8)], "id long, parent long")
    assert sorted(tuple(r) for r in trees.outcomes(odd).collect()) == [(1, "cycle", None), (2, "cycle", None), (3, "cycle", None), (4, "root", 0), (5, "root", 1), (6, "missing", 0), (7, "missing", 1), (8, "cycle", None)]


def test_clip_follows_its_paint():
    from lamella.operators.content import commands

    assert [c["kind"] for c in commands(b"q 0 0 1 1 re W f 0 0 2 2 re W* n Q")] == ["save", "paint", "clip", "clip", "restore"]


@pytest.mark.parametrize(
    "program, code",
    [(b"(a) w", "operand-kind"), (b"1.0 J", "operand-kind"), (b"3 j", "graphics-parameter"), (b"0.5 M", "graphics-parameter"), (b"[0 0] 1 d", "graphics-parameter"), (b"[/a] 1 d", "operand-kind"), (b"/DeviceRGB cs 1 sc", "color-components"), (b"8 Tr", "graphics-parameter"), (b"/P 3 BDC EMC", "operand-kind")],
)
def test_refused_state(program, code):
    with pytest.raises(c.DecodeError, match=code):
        content.commands(program)


def test_carried_state():
    last = content.commands(b"q 2 w 2 -1 0.5 rg /X CS 1 SC Q [] 0 d [2 0] 3 d /P << /A 1 >> BDC EMC 0 0 1 1 re S")[-1]["state"]
    assert last["line_width"] == content.UNIT and last["fill_color"] == (0,) and last["dash"] == (2 * content.UNIT, 0) and last["stroke_space"] == "DeviceGray"
    inside = content.commands(b"2 -1 0.5 rg /X CS 1 SC 0 0 1 1 re S")[-1]["state"]
    assert inside["fill_color"] == (content.UNIT, 0, content.UNIT // 2) and inside["stroke_space"] == "X" and inside["stroke_color"] == (content.UNIT,)


def test_division_does_not_round_twice(spark):
    """A quotient just below a half is not carried over it by the six places of a decimal division."""
    from pyspark.sql import functions as F

    from lamella.functions import fixed_point as fx

    for n in (499_999_999, 500_000_000, 1_499_999_999, 123_456_789_012_345_499_999_999, -499_999_999, -500_000_000):
        want = (1 if n > 0 else -1) * ((abs(n) * 2 + 1_000_000_000) // 2_000_000_000)
        row = spark.range(1).select(fx.divide_half_away(F.lit(str(n)).cast("decimal(37,0)"), fx.SCALE).alias("q")).first()
        assert int(row.q) == want, n
