"""Page programs: operators in order, their checks, and the fold to drawing commands."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.codecs import DecodeError
from ..sources.syntax import tokens

# Operators by the shape of their operands. n number, i whole number, N name, s string, a array, A array of numbers, D name or dictionary; c stands for one to four numbers.
SHAPES = {
    "": "q Q BT ET T* BX EX EMC h S s f F f* B B* b b* n W W*",
    "n": "Tc Tw Tz TL Ts w M G g",
    "i": "Tr J j",
    "N": "gs ri MP BMC CS cs Do",
    "s": "Tj '",
    "a": "TJ",
    "nn": "Td TD m l",
    "Nn": "Tf",
    "ND": "DP BDC",
    "An": "d",
    "nnn": "RG rg",
    "nns": '"',
    "nnnn": "v y re K k",
    "nnnnnn": "cm Tm c",
    "c": "SC sc SCN scn",
}
OPERANDS = {op: shape for shape, ops in SHAPES.items() for op in ops.split()}
ARITY = {op: (1, 4) if shape == "c" else (len(shape), len(shape)) for op, shape in OPERANDS.items()}
_FITS = {"n": ("int", "real"), "i": ("int",), "N": ("name",), "s": ("string", "hex"), "a": ("array", "numbers"), "A": ("numbers",), "D": ("name", "dict")}
# Device colour spaces with their first colour.
SPACES = {"DeviceGray": (0,), "DeviceRGB": (0, 0, 0), "DeviceCMYK": (0, 0, 0, 1)}
_COLORS = {"G": "DeviceGray", "RG": "DeviceRGB", "K": "DeviceCMYK"}
# Operators of text objects alone.
TEXT_ONLY = {"Td", "TD", "Tm", "T*", "Tj", "TJ", "'", '"'}
PAINTS = {"S": (0, 1), "s": (0, 1), "f": (1, 0), "F": (1, 0), "f*": (2, 0), "B": (1, 1), "B*": (2, 1), "b": (1, 1), "b*": (2, 1)}
UNIT = 1_000_000_000
_IDENTITY = (UNIT, 0, 0, UNIT, 0, 0)


def fixed(token) -> int:
    """A number as billionths, halves away from zero."""
    return int((Decimal(token) * UNIT).to_integral_value(ROUND_HALF_UP))


def _div(n: int) -> int:
    return (abs(n) * 2 + UNIT) // (2 * UNIT) * (1 if n >= 0 else -1)


def times(m: tuple, n: tuple) -> tuple:
    """First m, then n; each number rounded once."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return _div(a * p + b * r), _div(a * q + b * s), _div(c * p + d * r), _div(c * q + d * s), _div(e * p + f * r + t * UNIT), _div(e * q + f * s + u * UNIT)


def point(m: tuple, x: int, y: int) -> tuple[int, int]:
    return _div(m[0] * x + m[2] * y + m[4] * UNIT), _div(m[1] * x + m[3] * y + m[5] * UNIT)


def _program(data: bytes) -> list[tuple[int, str, list, int, list]]:
    """program() with the kinds of the operands; an array of numbers alone is of kind 'numbers'."""
    out, operands, kinds, open_ = [], [], [], []
    for kind, value, start, _ in tokens(data):
        if kind == "open":
            open_.append((value, [], []))
        elif kind == "close":
            if not open_:
                raise DecodeError("unopened")
            mark, done, inner = open_.pop()
            (open_[-1][1] if open_ else operands).append(done)
            (open_[-1][2] if open_ else kinds).append("dict" if mark == "<<" else "numbers" if set(inner) <= {"int", "real"} else "array")
        elif kind == "keyword" and not open_ and value not in ("true", "false", "null"):
            out.append((len(out), value, operands, start, kinds))
            operands, kinds = [], []
        else:
            (open_[-1][1] if open_ else operands).append(value)
            (open_[-1][2] if open_ else kinds).append(kind)
    if operands or open_:
        raise DecodeError("dangling-operands")
    return out


def program(data: bytes) -> list[tuple[int, str, list, int]]:
    """(ordinal, operator, operands, offset); arrays are lists. Unknown operators are rows like others."""
    return [row[:4] for row in _program(data)]


def check(ops: list) -> None:
    """Counts and kinds of operands, text objects, balanced stacks; an unknown operator passes between BX and EX only."""
    depth = text = marked = lenient = 0
    for _, op, operands, _, kinds in ops:
        if op not in ARITY:
            if not lenient:
                raise DecodeError("unknown-operator")
            continue
        low, high = ARITY[op]
        if not low <= len(operands) <= high:
            raise DecodeError("operand-count")
        shape = "n" * len(kinds) if OPERANDS[op] == "c" else OPERANDS[op]
        if any(kind not in _FITS[want] for kind, want in zip(kinds, shape, strict=True)):
            raise DecodeError("operand-kind")
        if op in TEXT_ONLY and not text or op == "BT" and text or op == "ET" and not text:
            raise DecodeError("text-object")
        text += (op == "BT") - (op == "ET")
        depth += (op == "q") - (op == "Q")
        marked += (op in ("BMC", "BDC")) - (op == "EMC")
        lenient += (op == "BX") - (op == "EX")
        if min(depth, marked, lenient) < 0:
            raise DecodeError("unbalanced")
    if depth or text or marked or lenient:
        raise DecodeError("unclosed")


#: The state that commands are drawn with, as a page begins. Numbers are billionths; colours are cut to 0..1.
INITIAL = {
    "fill_space": "DeviceGray", "fill_color": (0,), "stroke_space": "DeviceGray", "stroke_color": (0,), "line_width": UNIT, "line_cap": 0, "line_join": 0, "miter_limit": 10 * UNIT, "dash": (), "dash_phase": 0,
    "font": None, "font_size": 0, "char_spacing": 0, "word_spacing": 0, "scaling": UNIT, "render_mode": 0, "rise": 0, "leading": 0, "external": None, "intent": None,
}
_NUMBERS = {"w": "line_width", "M": "miter_limit", "Tc": "char_spacing", "Tw": "word_spacing", "TL": "leading", "Ts": "rise"}
_CHOICES = {"J": ("line_cap", 2), "j": ("line_join", 2), "Tr": ("render_mode", 7)}


def _set(state: dict, op: str, operands: list) -> dict:
    """The state after an operator that sets some of it; others leave it as it is."""

    def valid(ok: bool, **new) -> dict:
        if not ok:
            raise DecodeError("graphics-parameter")
        return state | new

    if op in _NUMBERS:
        v = fixed(operands[0])
        return valid(v >= {"w": 0, "M": UNIT}.get(op, v), **{_NUMBERS[op]: v})
    if op in _CHOICES:
        name, most = _CHOICES[op]
        return valid(0 <= operands[0] <= most, **{name: operands[0]})
    if op == "d":
        pattern = tuple(map(fixed, operands[0]))
        return valid(all(v >= 0 for v in pattern) and (not pattern or any(pattern)), dash=pattern, dash_phase=fixed(operands[1]))
    if op == "Tz":
        return state | {"scaling": _div(fixed(operands[0]) * (UNIT // 100))}
    if op == "Tf":
        return state | {"font": operands[0].decode("latin-1"), "font_size": fixed(operands[1])}
    if op == '"':
        return state | {"word_spacing": fixed(operands[0]), "char_spacing": fixed(operands[1])}
    if op in ("gs", "ri"):
        return state | {"external" if op == "gs" else "intent": operands[0].decode("latin-1")}
    side = "stroke" if op.isupper() else "fill"
    if op.upper() == "CS":
        space = operands[0].decode("latin-1")
        return state | {f"{side}_space": space, f"{side}_color": tuple(v * UNIT for v in SPACES[space]) if space in SPACES else None}
    if op.upper() in ("SC", "SCN", *_COLORS):
        space = _COLORS.get(op.upper(), state[f"{side}_space"])
        if space in SPACES and len(operands) != len(SPACES[space]):
            raise DecodeError("color-components")
        return state | {f"{side}_space": space, f"{side}_color": tuple(min(max(fixed(v), 0), UNIT) for v in operands)}
    return state


def commands(data: bytes) -> list[dict]:
    """Drawing commands of a program: kind, fill rule, whether stroked, bounds in billionths under the matrix then in force, and the state then set."""
    ops = _program(data)
    check(ops)
    out: list[dict] = []
    stack: list[tuple] = []
    ctm, line, state, points, start = _IDENTITY, _IDENTITY, INITIAL, [], (0, 0)
    clip: tuple[int, int] | None = None  # operator and rule of a clip that waits for the end of its path

    def emit(kind: str, op: int, fill: int = 0, stroke: int = 0, at: list | None = None) -> None:
        xs, ys = zip(*at, strict=True) if at else ((None,), (None,))
        out.append({"ordinal": op, "kind": kind, "fill": fill, "stroke": stroke, "x0": min(xs) if at else None, "y0": min(ys) if at else None, "x1": max(xs) if at else None, "y1": max(ys) if at else None, "state": state})

    for n, op, operands, _, _ in ops:
        if op in ARITY:
            state = _set(state, op, operands)
        if op == "q":
            stack.append((ctm, state))
            emit("save", n)
        elif op == "Q":
            ctm, state = stack.pop()
            emit("restore", n)
        elif op == "cm":
            ctm = times(tuple(map(fixed, operands)), ctm)
        elif op in ("m", "l"):
            start = tuple(map(fixed, operands))
            points.append(point(ctm, *start))
        elif op in ("c", "v", "y"):
            v = list(map(fixed, operands))
            points += [point(ctm, x, y) for x, y in zip(v[::2], v[1::2], strict=True)]
        elif op == "re":
            x, y, w, h = map(fixed, operands)
            points += [point(ctm, a, b) for a in (x, x + w) for b in (y, y + h)]
        elif op in PAINTS:
            if points:
                emit("paint", n, *PAINTS[op], points)
        elif op in ("W", "W*"):
            clip = n, 1 + (op == "W*")
        elif op == "BT":
            line = _IDENTITY
        elif op == "Tm":
            line = tuple(map(fixed, operands))
        elif op in ("Td", "TD"):
            x, y = map(fixed, operands)
            state = state | {"leading": -y} if op == "TD" else state
            line = times((UNIT, 0, 0, UNIT, x, y), line)
        elif op in ("T*", "'", '"'):
            line = times((UNIT, 0, 0, UNIT, 0, -state["leading"]), line)
        if op in PAINTS or op == "n":
            if clip and points:
                emit("clip", clip[0], clip[1], 0, points)
            clip, points = None, []
        if op in ("Tj", "TJ", "'", '"'):
            emit("glyphs", n, at=[point(times(line, ctm), 0, 0)])
        elif op == "Do":
            emit("image", n, at=[point(ctm, x, y) for x in (0, UNIT) for y in (0, UNIT)])
    return out


_COMMANDS = "page long, ordinal long, kind string, fill int, stroke int, x0 decimal(38,0), y0 decimal(38,0), x1 decimal(38,0), y1 decimal(38,0), outcome string"


#: Programs whose rows a task holds, and their bytes; beyond either they go, and it begins anew.
HELD, HELD_BYTES = 20_000, 1 << 24
#: Rows that leave a task together.
ROWS = 20_000


def _of_programs(pages: DataFrame, schema: str, rows_of: Callable[[bytes], list[tuple]]) -> DataFrame:
    """rows_of each page's program beside the page; a program that fails gives one row with nulls and the code. Pages without content give none.

    A task reads equal programs once as long as it holds their rows, which are then copied as whole Arrow columns.
    """
    fields = T.StructType.fromDDL(schema)
    own = pa.schema(list(to_arrow_schema(fields))[1:])

    def each(content: bytes) -> list[tuple]:
        try:
            return rows_of(content)
        except DecodeError as e:
            return [(*[None] * (len(own) - 1), str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}
        held, n_bytes = own.empty_table(), 0
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            programs = coded.dictionary.to_pylist()
            new = [p for p in programs if p not in known]
            if len(known) + len(new) > HELD or n_bytes > HELD_BYTES:
                known, held, n_bytes, new = {}, own.empty_table(), 0, programs
            rows: list[tuple] = []
            for p in new:
                found = each(p)
                known[p] = held.num_rows + len(rows), len(found)
                rows += found
                n_bytes += len(p) + 64 * len(found)
            if rows:
                more = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), own, strict=True)], own)
                held = pa.concat_tables([held, more]).combine_chunks()
            at, n = np.array([known[p] for p in programs] or [(0, 0)], np.int64).T
            code = coded.indices.fill_null(len(at)).to_numpy(zero_copy_only=False)
            at, n = np.append(at, 0)[code], np.append(n, 0)[code]
            page = np.repeat(np.arange(len(n)), n)
            row = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(page))
            for k in range(0, len(page), ROWS):
                out = held.take(pa.array(row[k : k + ROWS])).combine_chunks()
                columns = [batch.column(0).take(pa.array(page[k : k + ROWS])), *(c.chunk(0) for c in out.columns)]
                yield pa.RecordBatch.from_arrays(columns, fields.names)

    return pages.select("page", "content").mapInArrow(run, fields)


def page_commands(pages: DataFrame) -> DataFrame:
    """Command rows of pages (page, content); a page that fails has one row with the code, and no commands."""

    def rows_of(content: bytes) -> list[tuple]:
        return [(c["ordinal"], c["kind"], c["fill"], c["stroke"], *(None if c[k] is None else Decimal(c[k]) for k in ("x0", "y0", "x1", "y1")), "ready") for c in commands(content)]

    return _of_programs(pages, _COMMANDS, rows_of)


_STATES = "page long, ordinal long, kind string, fill_space string, fill_color array<long>, stroke_space string, stroke_color array<long>, line_width long, line_cap int, line_join int, miter_limit long, dash array<long>, dash_phase long, font string, font_size long, char_spacing long, word_spacing long, scaling long, render_mode int, rise long, leading long, external string, intent string, outcome string"


def page_states(pages: DataFrame) -> DataFrame:
    """The state that each paint, glyph and image command of pages (page, content) is drawn with; a page that fails has one row with the code."""
    names = [f.split()[0] for f in _STATES.split(", ")]

    def rows_of(content: bytes) -> list[tuple]:
        drawn = [c for c in commands(content) if c["kind"] in ("paint", "glyphs", "image")]
        return [(c["ordinal"], c["kind"], *(list(v) if isinstance(v, tuple) else v for v in (c["state"][n] for n in names[3:-1])), "ready") for c in drawn]

    return _of_programs(pages, _STATES, rows_of)
