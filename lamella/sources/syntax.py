"""Tokens, objects, cross-reference rows and content programs from bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.codecs import WHITE, DecodeError, literal_string, name_token


_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(\d+\.?\d*|\.\d+)")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")


def tokens(data: bytes, i: int = 0) -> Iterator[tuple[str, object, int, int]]:
    """From byte i on, (kind, value, start, end): int, real (kept as text), name, string, hex, open, close, keyword."""
    n = len(data)
    while (i := _SKIP.match(data, i).end()) < n:
        start, c = i, data[i : i + 1]
        if data[i : i + 2] in (b"<<", b">>"):
            i += 2
            yield ("open" if c == b"<" else "close"), data[start:i].decode(), start, i
        elif c in b"[]{}":
            i += 1
            yield ("open" if c in b"[{" else "close"), c.decode(), start, i
        elif c == b"/":
            m = _REGULAR.match(data, i + 1)
            i = m.end() if m else i + 1
            yield "name", name_token(data[start:i]), start, i
        elif c == b"(":
            i = _string_end(data, i)
            yield "string", literal_string(data[start:i]), start, i
        elif c == b"<":
            i = data.find(b">", i) + 1
            digits = bytes(x for x in data[start + 1 : i - 1] if x not in WHITE)
            if not i or re.fullmatch(rb"[0-9A-Fa-f]*", digits) is None:
                raise DecodeError("hex-string")
            yield "hex", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), start, i
        elif c in b")>":
            raise DecodeError("delimiter")
        else:
            word = _REGULAR.match(data, i).group()
            i += len(word)
            if _NUMBER.fullmatch(word):
                yield ("real", word.decode(), start, i) if b"." in word else ("int", int(word), start, i)
            else:
                yield "keyword", word.decode("latin-1"), start, i


def _string_end(data: bytes, i: int) -> int:
    depth = 0
    while i < len(data):
        c = data[i]
        if c == 0x5C:
            i += 1
        elif c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise DecodeError("string-no-end")


def direct_object(data: bytes, max_depth: int = 64):
    """The first object: numbers, bytes, lists, {"dict": [[key, value], ...]}, {"ref": [n, g]}, {"name": ...}, {"real": text}, true, false, null."""
    stream = list(tokens(data))
    value, _ = _object(stream, 0, max_depth)
    return value


def _object(stream: list, i: int, depth: int):
    if depth < 0:
        raise DecodeError("depth")
    if i >= len(stream):
        raise DecodeError("end")
    kind, value, *_ = stream[i]
    if kind == "int" and i + 2 < len(stream) and stream[i + 1][0] == "int" and stream[i + 2][:2] == ("keyword", "R") and value > 0:
        return {"ref": [value, stream[i + 1][1]]}, i + 3
    if kind == "real":
        return {"real": value}, i + 1
    if kind == "name":
        return {"name": value.decode("latin-1")}, i + 1
    if kind == "open":
        end, items, i = {"[": "]", "<<": ">>", "{": "}"}[value], [], i + 1
        while i < len(stream) and stream[i][:2] != ("close", end):
            item, i = _object(stream, i, depth - 1)
            items.append(item)
        if i >= len(stream):
            raise DecodeError("unclosed")
        if value != "<<":
            return items, i + 1
        if len(items) % 2 or not all(isinstance(k, dict) and "name" in k for k in items[::2]):
            raise DecodeError("dictionary-key")
        return {"dict": [[k["name"], v] for k, v in zip(items[::2], items[1::2], strict=True)]}, i + 1
    if kind == "keyword":
        if value not in ("true", "false", "null"):
            raise DecodeError("keyword")
        return {"true": True, "false": False, "null": None}[value], i + 1
    if kind == "close":
        raise DecodeError("unopened")
    return value, i + 1


def field(dictionary: dict, key: str, unique: bool = False):
    """The last value under a key; with unique, a repeated key is an error."""
    found = [v for k, v in dictionary["dict"] if k == key]
    if unique and len(found) > 1:
        raise DecodeError("duplicate-key")
    return found[-1] if found else None


_ROW = re.compile(rb"(\d{10}) (\d{5}) ([nf])(?: \r| \n|\r\n)")


def final_anchor(data: bytes, window: int = 1024) -> int:
    """The offset after the last startxref in the final bytes."""
    found = re.findall(rb"startxref[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+%%EOF", data[-window:])
    if not found:
        raise DecodeError("no-anchor")
    return int(found[-1])


def anchor_kind(data: bytes, at: int) -> str:
    return "table" if re.match(rb"xref\b", data[at : at + 5]) else "stream" if re.match(rb"\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj\b", data[at : at + 40]) else "unknown"


def xref_table(data: bytes, at: int) -> Iterator[tuple[int, int, str, int]]:
    """(object number, generation, kind, offset) of a table's rows, numbers rising."""
    i, last = _SKIP.match(data, at + 4).end(), -1
    while m := re.compile(rb"(\d+) (\d+)[\x00\t\n\x0c\r ]+").match(data, i):
        i = m.end()
        for number in range(int(m[1]), int(m[1]) + int(m[2])):
            row = _ROW.match(data, i)
            if row is None or number <= last:
                raise DecodeError("xref-row")
            yield number, int(row[2]), {b"n": "in-use", b"f": "free"}[row[3]], int(row[1])
            i, last = row.end(), number


def xref_stream_rows(payload: bytes, widths: list[int], index: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(object number, type, field 2, field 3) of fixed-width big-endian rows; an absent type is 1."""
    size = sum(widths)
    numbers = [k for a, n in zip(index[::2], index[1::2], strict=True) for k in range(a, a + n)]
    if not size or len(payload) != size * len(numbers):
        raise DecodeError("xref-stream-size")
    for r, number in enumerate(numbers):
        at, out = r * size, []
        for w in widths:
            out.append(int.from_bytes(payload[at : at + w], "big") if w else None)
            at += w
        yield number, 1 if out[0] is None else out[0], out[1] or 0, out[2] or 0


def object_stream(payload: bytes, n: int, first: int) -> Iterator[tuple[int, int, bytes]]:
    """(index, object number, bytes) of packed objects."""
    head = [v for k, v, *_ in tokens(payload[:first]) if k == "int"]
    if len(head) < 2 * n or len(set(head[: 2 * n : 2])) != n:
        raise DecodeError("object-stream-header")
    at = [first + x for x in head[1 : 2 * n : 2]] + [len(payload)]
    for k in range(n):
        yield k, head[2 * k], payload[at[k] : at[k + 1]]


def header_version(data: bytes) -> tuple[int, int]:
    m = re.match(rb"%PDF-(\d)\.(\d)", data)
    if m is None:
        raise DecodeError("header")
    return int(m[1]), int(m[2])
