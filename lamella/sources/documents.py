"""Documents from bytes: revisions newest first, entries of tables and streams, framed objects."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.codecs import DecodeError, decode, unpredict
from ..operators.revisions import latest_wins
from ..operators.trees import subtree_counts
from ..session import kept
from .syntax import anchor_kind, field, final_anchor, object_stream, tokens, xref_stream_rows, xref_table
from .syntax import _object as read_object

_TRAILER = re.compile(rb"trailer")
_BODY = re.compile(rb"\r\n|\n")
_AFTER = re.compile(rb"(?:\r\n|\r|\n)?endstream[\x00\t\n\x0c\r ]+endobj")
LIMIT = 1 << 26
#: So many rows, or bytes of text and streams in them, leave a task together.
ROWS, BYTES = 4000, 1 << 22
Row = tuple[int, int, int, int, str, int | None, int | None, int | None]


def indirect_object(data: bytes, at: int, length_of: Callable[[int], int] | None = None) -> tuple[int, int, object, bytes | None]:
    """(number, generation, value, raw stream bytes or None) of the object framed at a byte offset. `length_of` gives the value of a referenced length."""
    found: list = []
    for token in tokens(data, at):
        found.append(token)
        if token[0] == "keyword" and token[1] in ("endobj", "stream"):
            break
        if len(found) > 1 << 20:
            raise DecodeError("object-limit")
    else:
        raise DecodeError("object-end")
    if len(found) < 5 or [t[0] for t in found[:2]] != ["int", "int"] or found[2][:2] != ("keyword", "obj"):
        raise DecodeError("object-header")
    value, used = read_object(found, 3, 64)
    if used != len(found) - 1:
        raise DecodeError("object-body")
    if found[-1][1] == "endobj":
        return found[0][1], found[1][1], value, None
    start = _BODY.match(data, found[-1][3])
    length = field(value, "Length", unique=True) if isinstance(value, dict) and "dict" in value else None
    if isinstance(length, dict) and "ref" in length and length_of:
        length = length_of(length["ref"][0])
    if start is None or not isinstance(length, int) or length < 0 or not _AFTER.match(data, start.end() + length):
        raise DecodeError("stream-length")
    return found[0][1], found[1][1], value, data[start.end() : start.end() + length]


def _listed(value: object) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def stream_bytes(dictionary: dict, raw: bytes) -> bytes:
    """The payload of a stream after its filters, each with its predictor."""
    filters = [f["name"] for f in _listed(field(dictionary, "Filter", unique=True))]
    parms = _listed(field(dictionary, "DecodeParms", unique=True)) or [None] * len(filters)
    if len(parms) != len(filters):
        raise DecodeError("parameter-count")
    for name, p in zip(filters, parms, strict=True):
        raw = decode(raw, [name], LIMIT)
        if p is not None:
            raw = unpredict(raw, field(p, "Predictor") or 1, field(p, "Columns") or 1, field(p, "Colors") or 1, field(p, "BitsPerComponent") or 8)
    return raw


def _stream_rows(data: bytes, at: int, revision: int, part: int) -> tuple[list[Row], dict]:
    _, _, d, raw = indirect_object(data, at)
    if raw is None or field(d, "Type") != {"name": "XRef"}:
        raise DecodeError("xref-stream")
    index = field(d, "Index", unique=True) or [0, field(d, "Size", unique=True)]
    rows: list[Row] = []
    for number, kind, second, third in xref_stream_rows(stream_bytes(d, raw), field(d, "W", unique=True), index):
        if kind > 2:
            raise DecodeError("xref-type")
        rows.append((revision, part, number, 0, "packed", None, second, third) if kind == 2 else (revision, part, number, third, "in-use" if kind else "free", second if kind else None, None, None))
    return rows, d


def entries_of(data: bytes) -> tuple[list[Row], dict]:
    """(revision, part, object, generation, kind, offset, container, index) of every entry, newest revision first, and the newest trailer.

    Part 1 is a hybrid table's supplement, which counts after the table and before older revisions. An older anchor has to lie before the newer one.
    """
    at, before, rows, newest = final_anchor(data), len(data), [], None
    for revision in range(1 << 16):
        if not 0 <= at < before:
            raise DecodeError("anchor-order")
        kind = anchor_kind(data, at)
        if kind == "table":
            rows += [(revision, 0, n, g, k, o if k == "in-use" else None, None, None) for n, g, k, o in xref_table(data, at)]
            t = _TRAILER.search(data, at)
            if t is None:
                raise DecodeError("trailer")
            until = data.find(b"startxref", t.end())
            trailer, _ = read_object(list(tokens(data[t.end() : until])), 0, 64)
            if (extra := field(trailer, "XRefStm", unique=True)) is not None:
                rows += _stream_rows(data, extra, revision, 1)[0]
        elif kind == "stream":
            found, trailer = _stream_rows(data, at, revision, 0)
            rows += found
        else:
            raise DecodeError("anchor-kind")
        newest = newest or trailer
        before, older = at, field(trailer, "Prev", unique=True)
        if older is None:
            return rows, newest
        at = older
    raise DecodeError("revision-limit")


def objects_of(data: bytes) -> Iterator[tuple]:
    """(object, generation, type, numbers of its kids, its count, value as JSON, decoded stream, outcome) of every live object; one that does not decode has its code as the outcome."""
    live: dict[int, Row] = {}
    for row in entries_of(data)[0]:
        live.setdefault(row[2], row)
    packed: dict[int, dict[int, tuple[int, bytes]]] = {}

    def length_of(number: int) -> int:
        row = live.get(number)
        if row is None or row[4] != "in-use":
            raise DecodeError("stream-length")
        return indirect_object(data, row[5])[2]

    def contents(container: int) -> dict[int, tuple[int, bytes]]:
        if container not in packed:
            row = live.get(container)
            if row is None or row[4] != "in-use":
                raise DecodeError("container-missing")
            _, _, d, raw = indirect_object(data, row[5], length_of)
            if raw is None:
                raise DecodeError("container-kind")
            packed[container] = {i: (n, body) for i, n, body in object_stream(stream_bytes(d, raw), field(d, "N", unique=True), field(d, "First", unique=True))}
        return packed[container]

    for number, (_, _, _, generation, kind, offset, container, index) in sorted(live.items()):
        if kind == "free":
            continue
        try:
            stream = None
            if kind == "packed":
                n, body = contents(container).get(index, (None, b""))
                if n != number:
                    raise DecodeError("packed-identity")
                value = read_object(list(tokens(body)), 0, 64)[0]
            else:
                n, g, value, raw = indirect_object(data, offset, length_of)
                if (n, g) != (number, generation):
                    raise DecodeError("object-identity")
                stream = stream_bytes(value, raw) if raw is not None else None
            is_dict = isinstance(value, dict) and "dict" in value
            name = field(value, "Type") if is_dict else None
            kids = field(value, "Kids") if is_dict else None
            below = [k["ref"][0] for k in kids if isinstance(k, dict) and "ref" in k] if isinstance(kids, list) else None
            count = field(value, "Count") if is_dict else None
            yield number, generation, name["name"] if isinstance(name, dict) and "name" in name else None, below, count if isinstance(count, int) else None, json.dumps(value, default=lambda b: b.decode("latin-1")), stream, "ready"
        except DecodeError as e:
            yield number, generation, None, None, None, None, None, str(e)


def _each(docs: DataFrame, key: str, content: str, schema: str, rows: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """rows() of each document in its own task, a document at a time; one that cannot be read gives one row with nulls and its code as the outcome."""
    fields = T.StructType([docs.schema[key], *T.StructType.fromDDL(schema).fields])
    own = to_arrow_schema(fields)
    width = len(own) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, found, held = [], [], 0

            def table() -> pa.RecordBatch:
                columns = zip(*found, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, list(own)[1:], strict=True))], own.names)  # noqa: B023

            for n, data in enumerate(batch.column(1)):
                data = data.as_py()
                try:
                    out = list(rows(data)) if data is not None else [(*[None] * width, "missing")]
                except (DecodeError, AttributeError, IndexError, KeyError, TypeError, ValueError) as e:
                    out = [(*[None] * width, str(e) if type(e) is DecodeError else "malformed")]
                who += [n] * len(out)
                found += out
                held += sum(len(v) for r in out for v in r if isinstance(v, str | bytes))
                # rows of many documents go together, large values soon
                if len(found) >= ROWS or held >= BYTES:
                    yield table()
                    who, found, held = [], [], 0
            if found:
                yield table()

    return docs.select(key, content).mapInArrow(run, fields)


def entries(docs: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Every entry of every revision of documents as bytes (spark.read.format('binaryFile') gives path and content)."""
    return _each(docs, key, content, "revision int, part int, object long, generation long, kind string, offset long, container long, index long, outcome string", lambda d: ((*r, "ready") for r in entries_of(d)[0]))


def effective_entries(rows: DataFrame, key: str = "path") -> DataFrame:
    """The entry that holds for each object, over all revisions; freed objects are left out."""
    rank = rows.where("outcome = 'ready'").withColumn("_r", -F.col("revision")).withColumn("_p", -F.col("part"))
    return latest_wins(rank, [key, "object"], ["_r", "_p"], ["generation", "kind", "offset", "container", "index"], F.col("kind") == "free")


def objects(docs: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Every live object of documents as bytes, with its value and decoded stream."""
    return _each(docs, key, content, "object long, generation long, type string, kids array<long>, declared long, value string, stream binary, outcome string", objects_of)


def page_counts(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, root, pages, outcome) of the page tree of each document from its objects: 'ready', 'count-mismatch' at some inner node, or 'child-repeats'."""
    nodes = kept(rows.where("outcome = 'ready' and type in ('Pages', 'Page')").select(key, "object", "type", "kids", "declared"))  # documents are read once
    below = nodes.where("type = 'Pages'").select(key, F.col("object").alias("_parent"), F.explode("kids").alias("object"))
    placed = below.groupBy(key, "object").agg(F.min("_parent").alias("_parent"), F.count("*").alias("_times"))
    tree = kept(nodes.join(placed, [key, "object"], "left"))
    name = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(key).alias("k"), F.col(c).alias("o")))
    counts = subtree_counts(tree.select(name("object").alias("id"), name("_parent").alias("parent"), (F.col("type") == "Page").alias("is_leaf"), "declared"))
    repeats = tree.groupBy(key).agg(F.max(F.coalesce("_times", F.lit(0)) > 1).alias("_repeats"))
    roots = tree.where("type = 'Pages' and _parent is null").groupBy(key).agg(F.min("object").alias("root"))
    whole = counts.groupBy(F.col("id.k").alias(key)).agg(F.min("ok").alias("_ok"))
    at_root = counts.select(F.col("id.k").alias(key), F.col("id.o").alias("root"), F.col("leaves").cast("long").alias("pages"))
    outcome = F.when(F.col("_repeats"), "child-repeats").when(F.col("_ok"), "ready").otherwise("count-mismatch")
    return roots.join(at_root, [key, "root"]).join(whole, key).join(repeats, key).select(key, "root", "pages", outcome.alias("outcome"))
