"""Byte decoders. Each gives a result or a code for why there is none; nothing is ever half decoded.

Byte-level state machines have no Catalyst expression: they run in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that the format counts as white space.
WHITE = b"\x00\t\n\x0c\r "
OUTCOME = T.StructType([T.StructField("status", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("code", T.StringType())])


class DecodeError(ValueError):
    """Its text is the code of the outcome."""


def ascii_hex(data: bytes, limit: int) -> bytes:
    body, mark, rest = data.partition(b">")
    digits = bytes(c for c in body if c not in WHITE)
    if not mark:
        raise DecodeError("hex-no-end")
    if rest.strip(WHITE):
        raise DecodeError("trailing-data")
    if len(digits) > 2 * limit:
        raise DecodeError("output-limit")
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    except (ValueError, UnicodeDecodeError):
        raise DecodeError("hex-digit") from None


def ascii85(data: bytes, limit: int) -> bytes:
    body, mark, rest = data.partition(b"~>")
    if not mark:
        raise DecodeError("a85-no-end")
    if rest.strip(WHITE):
        raise DecodeError("trailing-data")
    out, group = bytearray(), []
    for c in body:
        if c in WHITE:
            continue
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _word(group)
                group = []
        else:
            raise DecodeError("a85-digit")
        if len(out) > limit:
            raise DecodeError("output-limit")
    if len(group) == 1:
        raise DecodeError("a85-single")
    if group:
        out += _word(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _word(group: list[int]) -> bytes:
    n = 0
    for d in group:
        n = n * 85 + d
    if n >> 32:
        raise DecodeError("a85-range")
    return n.to_bytes(4, "big")


def run_length(data: bytes, limit: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n == 128:
            if i + 1 < len(data):
                raise DecodeError("trailing-data")
            return bytes(out)
        piece = data[i + 1 : i + 2 + n] if n < 128 else data[i + 1 : i + 2] * (257 - n)
        if len(piece) != (n + 1 if n < 128 else 257 - n):
            raise DecodeError("rl-short")
        out += piece
        i += n + 2 if n < 128 else 2
        if len(out) > limit:
            raise DecodeError("output-limit")
    raise DecodeError("rl-no-end")


def flate(data: bytes, limit: int) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, limit + 1)
    except zlib.error:
        raise DecodeError("flate-data") from None
    if len(out) > limit:
        raise DecodeError("output-limit")
    if not d.eof:
        raise DecodeError("flate-short")
    if d.unused_data:
        raise DecodeError("trailing-data")
    return out


FILTERS: dict[str, Callable[[bytes, int], bytes]] = {"ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length, "FlateDecode": flate}


def decode(data: bytes, filters: list[str], limit: int) -> bytes:
    """The filters in order; the limit holds for each one's output and, fourfold, for all together."""
    total = 0
    for name in filters:
        if name not in FILTERS:
            raise DecodeError("filter-unsupported")
        data = FILTERS[name](data, limit)
        total += len(data)
        if total > 4 * limit:
            raise DecodeError("total-limit")
    return data


def png_rows(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes the row predictors None, Sub, Up, Average and Paeth."""
    bpp, size = max(1, colors * bits // 8), (columns * colors * bits + 7) // 8
    if len(data) % (size + 1):
        raise DecodeError("png-rows")
    out, above = bytearray(), bytearray(size)
    for at in range(0, len(data), size + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + size])
        if kind > 4:
            raise DecodeError("png-kind")
        for i in range(size):
            a, b, c = (row[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
            if kind == 1:
                p = a
            elif kind == 2:
                p = b
            elif kind == 3:
                p = (a + b) // 2
            elif kind == 4:
                # the nearest of left, above and upper left to left + above - upper left, in this order
                p = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            else:
                p = 0
            row[i] = (row[i] + p) & 255
        out += row
        above = row
    return bytes(out)


def tiff_rows(data: bytes, columns: int, colors: int = 1) -> bytes:
    """Undoes horizontal differences of 8-bit samples."""
    size = columns * colors
    if len(data) % size:
        raise DecodeError("tiff-rows")
    out = bytearray(data)
    for at in range(0, len(out), size):
        for i in range(at + colors, at + size):
            out[i] = (out[i] + out[i - colors]) & 255
    return bytes(out)


def text_string(data: bytes) -> str:
    """UTF-16BE after FE FF; otherwise one byte a character, where control bytes under 24 but tab and line ends are undefined."""
    if data[:2] == b"\xfe\xff":
        try:
            return data[2:].decode("utf-16-be")
        except UnicodeDecodeError:
            raise DecodeError("text-utf16") from None
    if any(c < 24 and c not in (9, 10, 13) or c in (127, 159, 173) for c in data):
        raise DecodeError("text-undefined")
    # Characters of bytes 24 to 31 and 128 to 160 in the format's own encoding.
    low = "˘ˇˆ˙˝˛˚˜"
    high = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"
    return "".join(low[c - 24] if 24 <= c < 32 else high[c - 128] if 128 <= c <= 160 else chr(c) for c in data)


def name_token(data: bytes) -> bytes:
    """A name without its slash, #xx being a byte."""
    out, i = bytearray(), 1
    while i < len(data):
        if data[i] == 0x23:
            try:
                out.append(int(data[i + 1 : i + 3].decode("ascii"), 16) if len(data[i + 1 : i + 3]) == 2 else -1)
            except ValueError:
                raise DecodeError("name-escape") from None
            i += 3
        else:
            out.append(data[i])
            i += 1
    return bytes(out)


def literal_string(data: bytes) -> bytes:
    """The bytes of a parenthesised string: escapes, octal codes, folded line ends, balanced parentheses."""
    plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
    out, depth, i = bytearray(), 1, 1
    while i < len(data):
        c = data[i]
        i += 1
        if c == 0x5C:
            if i >= len(data):
                break
            c = data[i]
            i += 1
            if 0x30 <= c <= 0x37:
                n = c - 0x30
                for _ in range(2):
                    if i < len(data) and 0x30 <= data[i] <= 0x37:
                        n, i = n * 8 + data[i] - 0x30, i + 1
                out.append(n & 255)
            elif c in (10, 13):
                i += c == 13 and data[i : i + 1] == b"\n"
            else:
                out.append(plain.get(c, c))
            continue
        if c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
            if not depth:
                return bytes(out)
        elif c == 13:
            i += data[i : i + 1] == b"\n"
            c = 10
        out.append(c)
    raise DecodeError("string-no-end")


def decoded(data: Column, filters: Column, limit: int = 1 << 24) -> Column:
    """A struct (status, data, code) of binary data under an array of filter names."""

    @F.pandas_udf(OUTCOME)
    def run(d: pd.Series, f: pd.Series) -> pd.DataFrame:
        out = []
        for x, names in zip(d, f, strict=True):
            try:
                out.append(("ready", decode(bytes(x), list(names), limit), None) if x is not None else ("failed", None, "missing"))
            except DecodeError as e:
                out.append(("unsupported" if str(e) == "filter-unsupported" else "failed", None, str(e)))
        return pd.DataFrame(out, columns=["status", "data", "code"])

    return run(data, filters)


def unpredict(data: bytes, predictor: int, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes a predictor by its number: 1 none, 2 differences of 8-bit samples, 10 to 15 rows that name their own."""
    if predictor == 1:
        return data
    if columns < 1 or colors < 1:
        raise DecodeError("predictor-parameters")
    if predictor == 2 and bits == 8:
        return tiff_rows(data, columns, colors)
    if 10 <= predictor <= 15:
        return png_rows(data, columns, colors, bits)
    raise DecodeError("predictor-unsupported")


def predicted(data: Column, predictor: Column, columns: Column) -> Column:
    """A struct (status, data, code) of binary data after its predictor."""

    @F.pandas_udf(OUTCOME)
    def run(d: pd.Series, p: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for x, kind, width in zip(d, p, c, strict=True):
            try:
                out.append(("ready", unpredict(bytes(x), int(kind), int(width)), None) if x is not None else ("failed", None, "missing"))
            except DecodeError as e:
                out.append(("unsupported" if str(e) == "predictor-unsupported" else "failed", None, str(e)))
        return pd.DataFrame(out, columns=["status", "data", "code"])

    return run(data, predictor, columns)
