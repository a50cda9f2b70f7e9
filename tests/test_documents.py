"""Documents with tables, streams, packed objects, hybrids and older revisions."""

import json
import zlib

import pytest

from lamella.functions.codecs import DecodeError
from lamella.sources import documents

HEAD = b"%PDF-1.7\n"


def end(at):
    return b"startxref\n%d\n%%%%EOF\n" % at


def xref_stream(number, rows, extra=b"", predictor=False):
    payload = b"".join(bytes([t]) + a.to_bytes(3, "big") + bytes([g]) for _, t, a, g in rows)
    parms = b""
    if predictor:  # rows of five bytes, each less the one above
        cut = [payload[i : i + 5] for i in range(0, len(payload), 5)]
        payload = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above)) for row, above in zip(cut, [bytes(5), *cut]))
        parms = b"/DecodeParms << /Predictor 12 /Columns 5 >>"
    z = zlib.compress(payload)
    index = b" ".join(b"%d 1" % n for n, *_ in rows)
    return b"%d 0 obj\n<< /Type /XRef /Size 99 /W [1 3 1] /Index [%s] /Filter /FlateDecode %s /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (number, index, parms, len(z), extra, z)


def packed_document(predictor=False, wrong=False):
    body = b"5 0 6 3 42 (six)" if not wrong else b"5 0 7 3 42 (six)"
    z = zlib.compress(body)
    holder = b"4 0 obj\n<< /Type /ObjStm /N 2 /First 8 /Filter /FlateDecode /Length 8 0 R >>\nstream\n" + z + b"\nendstream\nendobj\n"
    length = b"8 0 obj\n%d\nendobj\n" % len(z)
    at4, at8 = len(HEAD), len(HEAD + holder)
    at = at8 + len(length)
    return HEAD + holder + length + xref_stream(9, [(0, 0, 0, 255), (4, 1, at4, 0), (5, 2, 4, 0), (6, 2, 4, 1), (8, 1, at8, 0)], predictor=predictor) + end(at)


def table_document(prev=None, hybrid=False):
    one, two = b"1 0 obj\n(old)\nendobj\n", b"2 0 obj\n[1 0 R]\nendobj\n"
    a1, a2 = len(HEAD), len(HEAD + one)
    at = a2 + len(two)
    first = HEAD + one + two + b"xref\n0 3\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \ntrailer\n<< /Size 3 >>\n" % (a1, a2) + end(at)
    new = b"1 0 obj\n(new)\nendobj\n"
    an = len(first)
    extra, stm = b"", b""
    if hybrid:
        stm = xref_stream(9, [(1, 1, a1, 0), (7, 1, a2, 0)])
        extra = b"/XRefStm %d" % (an + len(new))
    later = an + len(new) + len(stm)
    return first + new + stm + b"xref\n1 2\n%010d 00000 n \n0000000000 00001 f \ntrailer\n<< /Size 3 /Prev %d %s >>\n" % (an, at if prev is None else prev, extra) + end(later)


def live(data):
    return {n: (json.loads(v) if v else None, outcome) for n, _, _, _, _, v, _, outcome in documents.objects_of(data)}


@pytest.mark.parametrize("predictor", [False, True])
def test_packed(predictor):
    out = live(packed_document(predictor))
    assert out[5] == (42, "ready") and out[6] == ("six", "ready") and out[8][1] == "ready" and set(out) == {4, 5, 6, 8}


def test_packed_identity():
    assert live(packed_document(wrong=True))[6] == (None, "packed-identity")


def test_newest_wins_and_free_hides():
    assert live(table_document()) == {1: ("new", "ready")}


def test_hybrid_supplement_counts_after_its_table():
    out = live(table_document(hybrid=True))
    assert out[1] == ("new", "ready") and out[7] == (None, "object-identity") and 2 not in out


@pytest.mark.parametrize("prev", [10**6, -1])
def test_older_anchor_lies_before(prev):
    with pytest.raises(DecodeError, match="anchor-order"):
        documents.entries_of(table_document(prev=prev))


@pytest.mark.parametrize(
    "text, code",
    [(b"1 0 obj\n<< /Length 9 >>\nstream\nab\nendstream\nendobj\n", "stream-length"), (b"1 0 obj\n(a)\n", "object-end"), (b"1 obj\n(a)\nendobj\n", "object-header"), (b"1 0 obj\n(a) (b)\nendobj\n", "object-body")],
)
def test_frames(text, code):
    with pytest.raises(DecodeError, match=code):
        documents.indirect_object(text, 0)


def test_tables_of_documents(spark):
    rows = [("a", bytearray(packed_document())), ("b", bytearray(table_document())), ("c", bytearray(b"nothing")), ("d", None), ("e", bytearray())]
    docs = spark.createDataFrame(rows, "path string, content binary")
    found = documents.entries(docs)
    assert {(r.path, r.outcome) for r in found.where("outcome <> 'ready'").collect()} == {("c", "no-anchor"), ("d", "missing"), ("e", "no-anchor")}
    assert {(r.path, r.object) for r in documents.effective_entries(found).collect()} == {("a", 4), ("a", 5), ("a", 6), ("a", 8), ("b", 1)}
    assert {(r.path, r.object, r.value) for r in documents.objects(docs).where("outcome = 'ready' and stream is null").collect()} == {("a", 5, "42"), ("a", 6, '"six"'), ("a", 8, str(len(zlib.compress(b"5 0 6 3 42 (six)")))), ("b", 1, '"new"')}
    assert documents.objects(docs.limit(0)).count() == 0


def test_documents_are_dealt_and_leave_together(spark, monkeypatch):
    """Documents of one small file are read by several tasks; rows of many documents are one batch."""
    from lamella.plans import file_queries
    from lamella.sources import documents

    docs = file_queries._bytes(spark, "/root/testdata/sf0.001")
    assert docs.rdd.getNumPartitions() > 1
    sizes: list = []
    real = documents.pa.RecordBatch.from_arrays

    class Told:
        @staticmethod
        def from_arrays(*x):
            sizes.append(real(*x).num_rows)
            return real(*x)

    batch = documents.pa.record_batch({"c_custkey": [1, 2, 3], "content": [b"x", None, b"y"]})
    run: list = []
    plain = type("D", (), {"schema": docs.schema, "select": lambda self, *_: self, "mapInArrow": lambda self, f, s: run.append(f)})()
    documents.entries(plain, "c_custkey")
    monkeypatch.setattr(documents.pa, "RecordBatch", Told)
    out = list(run[0]([batch]))
    assert sizes == [3] and out[0].column("outcome").to_pylist() == ["no-anchor", "missing", "no-anchor"]


def test_page_counts_read_documents_once(spark):
    """The objects of documents are made once, however often the page tree asks for them."""
    from lamella.plans import file_queries

    plan = file_queries.document_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "PythonUDF" not in plan
