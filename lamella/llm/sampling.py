"""SentencePiece segmentations sampled without replacement, by Gumbel top-k over the lattice.

The paths of a text's lattice split into regions: those that share some first steps
and leave out some choices at the next. Each region has a perturbed
maximum, a Gumbel number around its log mass and below that of the region it came
from. A search takes the best region, draws a path of it, and splits what is left
at every step of that path. So distinct paths come out in the order of their
perturbed scores, which is sampling without replacement; the best region left over
gives the bound kappa of the inclusion scores. Everything random follows
from the seed and the row's key.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import bisect_right
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded
from .text import released

GENERATION = 20_000
SPACE = "▁"


_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def units_of(text: str) -> list[str]:
    """Parts over whose borders no piece reaches: words with the run of spaces before them, line feeds, and runs of spaces at a line's end."""
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Lattice:
    """A unit's steps: at[pos] = (ends, ids, probabilities summed up, log probabilities) given that a path is there."""

    __slots__ = ("at",)

    def __init__(self, at):
        self.at = at


class Sampler:
    """Weights are Zipf's by merge rank for a BPE model, whose scores are ranks, and its own log probabilities for a unigram model."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.weight: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        scores = [model.get_score(i) for i in range(n)]
        ranked = all(s == int(s) for s in scores)
        self.text = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.weight[piece] = i, theta * (-log(2 - scores[i]) if ranked else scores[i])
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.weight))
        self.rare = min(w for _, w in self.weight.values()) - 10  # of a character by its bytes
        self.young: dict[str, Lattice] = {}
        self.old: dict[str, Lattice] = {}

    def lattice(self, unit: str) -> Lattice:
        found = self.young.get(unit)
        if found is None:
            found = self.old.get(unit) or self._build(unit)
            if len(self.young) > GENERATION:
                self.old, self.young = self.young, {}
            self.young[unit] = found
        return found

    def _build(self, unit: str) -> Lattice:
        n, weight = len(unit), self.weight
        mass = [0.0] * (n + 1)
        at: list = [None] * n
        for i in range(n - 1, -1, -1):
            ends, ids, w = [], [], []
            for j in range(i + 1, min(n, i + self.longest) + 1):
                got = weight.get(unit[i:j])
                if got is not None:
                    ends.append(j)
                    ids.append((got[0],))
                    w.append(got[1] + mass[j])
            if not ends or ends[0] != i + 1:  # a character that is no piece goes by its bytes
                ends.append(i + 1)
                ids.append(tuple(self.byte[b] for b in unit[i].encode()))
                w.append(self.rare + mass[i + 1])
            top = max(w)
            mass[i] = top + log(sum(exp(x - top) for x in w))
            logs = [x - mass[i] for x in w]
            total, sums = 0.0, []
            for x in logs:
                total += exp(x)
                sums.append(total)
            at[i] = ends, ids, sums, logs
        return Lattice(at)

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation; the space put before the text is taken off."""
        return b"".join(self.text[i] for i in array("I", ids)).decode("utf-8", "replace")[1:]

    def sample(self, text: str, k: int, seed: int) -> list[tuple[float, float, bytes]]:
        """Up to k distinct segmentations (log probability, inclusion score, ids), best perturbed score first."""
        lattices = [self.lattice(u) for u in units_of(text)]
        if not lattices:
            return [(0.0, 1.0, b"")]
        rng = np.random.Generator(np.random.Philox(key=seed & 0xFFFFFFFFFFFFFFFF))
        out: list[tuple[float, float, bytes]] = []
        # a region: (-perturbed score, tie, first steps, unit, place in it, choices left out, log probability of the first steps)
        queue: list = [(-float(rng.gumbel()), 0, [], 0, 0, (), 0.0)]
        tie = 0
        while queue and len(out) < k:
            minus, _, before, unit, place, without, logp = heapq.heappop(queue)
            score, steps, fresh = -minus, list(before), len(before)
            draws = iter(())
            while unit < len(lattices):
                at = lattices[unit].at
                while place < len(at):
                    ends, ids, sums, logs = at[place]
                    if without:
                        left = [c for c in range(len(ends)) if c not in without]
                        p = np.exp([logs[c] for c in left])
                        c = left[min(len(left) - 1, int(np.searchsorted(np.cumsum(p) / p.sum(), rng.random(), "right")))]
                    elif len(ends) == 1:
                        c = 0
                    else:
                        u = next(draws, None)
                        if u is None:
                            draws = iter(rng.random(256).tolist())
                            u = next(draws)
                        c = min(bisect_right(sums, u * sums[-1]), len(ends) - 1)
                    steps.append((unit, place, c, ids[c], logs[c], without))
                    without = ()
                    place = ends[c]
                unit, place = unit + 1, 0
            new = steps[fresh:]
            own = np.array([s[4] for s in new])
            ahead = logp + np.concatenate(([0.0], np.cumsum(own)[:-1]))
            total = logp + float(own.sum())
            # what each step leaves: the choices that it neither took nor had lost before
            rest = np.array([self._rest(lattices[s[0]].at[s[1]], s[2], s[5]) for s in new])
            with np.errstate(divide="ignore"):
                value = -np.logaddexp(-score, np.log(rng.standard_exponential(len(new))) - (ahead + np.log(rest)))
            value[rest <= 0] = -np.inf
            want = k - len(out) + 1
            for j in np.argsort(-value, kind="stable")[:want]:
                if value[j] > -np.inf:
                    tie += 1
                    u, p, c, _, _, lost = new[j]
                    heapq.heappush(queue, (-float(value[j]), tie, steps[: fresh + int(j)], u, p, (*lost, c), float(ahead[j])))
            out.append((total, score, array("I", [i for s in steps for i in s[3]]).tobytes()))
        kappa = -queue[0][0] if queue else -float("inf")
        return [(lp, -float(np.expm1(-exp(min(700.0, lp - kappa)))) if kappa > -float("inf") else 1.0, ids) for lp, _, ids in out]

    @staticmethod
    def _rest(at, c: int, lost: tuple) -> float:
        """Mass of the other choices, none where there are none."""
        ends, _, _, logs = at
        if len(ends) == 1 + len(lost):
            return 0.0
        if not lost and logs[c] < -0.01:
            return -float(np.expm1(logs[c])) if logs[c] > -1e-3 else 1 - exp(logs[c])
        return sum(exp(x) for i, x in enumerate(logs) if i != c and i not in lost)


_samplers: dict[tuple[str, float], Sampler] = {}


def segmentations(table: DataFrame, model_path: str, keys: tuple[str, ...], k: int = 2, theta: float = 1.0, seed: int = 0, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Up to k rows for each row of table: its keys (as long), sample (from 0), n_pieces, ids_crc32, log_prob, inclusion, round_trip[, ids].

    A null or empty text has one segmentation, of no pieces. Rows with equal keys and texts draw alike; null keys count as a value.
    inclusion: the chance that a path with this log probability is above the bound kappa; 1 if no path is left over.
    round_trip: whether decoding gives the text back, U+2581 being read as a space.
    """
    names = [*keys, "sample", "n_pieces", "ids_crc32", "log_prob", "inclusion", "round_trip"] + ["ids"] * with_ids
    schema = ", ".join([*(f"{c} long" for c in keys), "sample int", "n_pieces long", "ids_crc32 long", "log_prob double", "inclusion double", "round_trip boolean"] + ["ids binary"] * with_ids)
    types = [*(pa.int64() for _ in keys), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()] + [pa.binary()] * with_ids

    @released
    def run(batches):
        key = model_path, theta
        sampler = _samplers.get(key) or _samplers.setdefault(key, Sampler(*key))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cols: list[list] = [[] for _ in names]
                for text, row_seed, *own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = text or ""
                    for n, (lp, inclusion, ids) in enumerate(sampler.sample(text, k, row_seed)):
                        values = [*own, n, len(ids) // 4, zlib.crc32(ids), lp, inclusion, sampler.decode(ids) == text.replace(SPACE, " ")] + [ids] * with_ids
                        for c, v in zip(cols, values, strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    bounded(table.sparkSession)
    rows = table.select(F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.lit(seed), *keys).alias("_seed"), *(F.col(c).cast("long").alias(c) for c in keys))
    return rows.mapInArrow(run, schema)
