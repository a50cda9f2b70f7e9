"""Toxicity by a logistic model whose fit penalises score changes when identity terms are swapped.

Features are whether a text has a word, or a word that begins with given 4 to 6
bytes (compounds carry their stem at the front). The words that tell the classes apart in the sample
become the model's features; the fit then minimises log loss, a ridge, and
the squared change of the raw score between each training text that names a
group and its counterfactual, in which the term is swapped for another of its set.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import NEVER, key_of, met
from .store import Store, bounded
from .text import U, released, slices

PREFIXES = (4, 5, 6)
#: Rows that the model is fitted on, at most, and features that it has, at most.
SAMPLE_ROWS, FEATURES, LEAST_TEXTS, LEAST_CHI = 16384, 4096, 4, 24.0
#: Sets of terms that may stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "paralyzed"),
)


def _trim(words) -> None:
    """Leave ASCII punctuation off the ends of words, in place."""
    mark = np.zeros(256, bool)
    mark[list(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")] = True
    for _ in range(3):
        long = words.end - words.start > 1
        words.end = words.end - (long & mark[words.data[np.maximum(words.end - 1, 0)]])
        long = words.end - words.start > 1
        words.start = words.start + (long & mark[words.data[words.start]])


def word_features(words) -> list[np.ndarray]:
    """For each kind of feature, the hash of every word's; 0 where a word has none."""
    _trim(words)
    return [words.hashes() | U(1), *(words.prefix_hashes(n) for n in PREFIXES)]


def _one_word(term: str) -> list[int]:
    (found,) = slices(pa.array([term]), lower=True)
    return [int(f[0]) for f in word_features(found[2])]


def _owner(words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


def _distinct_features(words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs without repeats."""
    owner = _owner(words)
    kinds = word_features(words)
    f, t = np.concatenate(kinds), np.concatenate([owner] * len(kinds))
    t, f = t[f != 0], f[f != 0]
    order = np.lexsort((f, t))
    t, f = t[order], f[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (t[1:] != t[:-1])
    return t[new], f[new]


@released
def _count(batches):
    """Texts with each feature, by label, of one partition's slices."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        for i, _, words in slices(batch.column(0), lower=True):
            t, f = _distinct_features(words)
            own, at = np.unique(f, return_inverse=True)
            toxic = label[i + t]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(at[toxic == 1], minlength=len(own))), pa.array(np.bincount(at[toxic == 0], minlength=len(own)))], ["feature", "n1", "n0"])


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self._seen = np.zeros(1 << 16, bool)
        self._seen[(self.features >> U(48)).astype(np.intp)] = True

    def places(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature's place) pairs without repeats."""
        owner, found = _owner(words), []
        for f in word_features(words):
            at = np.flatnonzero(self._seen[(f >> U(48)).astype(np.intp)])
            if len(self.features) and len(at):
                place = np.minimum(np.searchsorted(self.features, f[at]), len(self.features) - 1)
                ok = self.features[place] == f[at]
                found.append(owner[at[ok]] * len(self.features) + place[ok])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.divmod(pair, max(1, len(self.features)))

    def scores(self, words) -> np.ndarray:
        n = len(words.first) - 1
        t, p = self.places(words)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(t, self.weights[p], minlength=n))))


def fit(rows: list[tuple[np.ndarray, int]], features: np.ndarray, swaps: list[list[list[int]]], ridge: float = 0.0005, fairness: float = 1.0, positive: float = 2.0, steps: int = 400) -> Model:
    """rows: (places of a text's features, label). swaps: sets of terms, each the places of a term's features.

    Minimises the mean log loss (toxic rows weighing `positive`) + ridge |w|^2 / 2 + fairness * the mean squared
    change of the raw score over counterfactuals, by accelerated gradient steps.
    """
    y = np.array([r[1] for r in rows], float)
    t = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    p = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -20.0
    if not len(p):
        return Model(features, np.zeros(len(features)), prior)
    ca, cb, n_swaps = [], [], 0  # of each counterfactual, (its number, place) left and entered
    for places, _ in rows:
        own = set(places.tolist())
        for terms in swaps:
            for x in terms:
                if x and own.issuperset(x):
                    for z in terms:
                        if z != x:
                            ca += [(n_swaps, k) for k in x if k not in z]
                            cb += [(n_swaps, k) for k in z if k not in own]
                            n_swaps += 1
    a, b = (np.array(c, np.int64).reshape(-1, 2).T for c in (ca, cb))
    w, bias, vw, vb = np.zeros(len(features)), prior, np.zeros(len(features)), 0.0
    n, size = len(rows), len(w)

    def swapped(x: np.ndarray) -> np.ndarray:
        """The gradient of half the mean squared change at x."""
        if not n_swaps:
            return np.zeros(size)
        change = np.bincount(b[0], x[b[1]], minlength=n_swaps) - np.bincount(a[0], x[a[1]], minlength=n_swaps)
        return (np.bincount(b[1], change[b[0]], minlength=size) - np.bincount(a[1], change[a[0]], minlength=size)) / n_swaps

    # the largest curvature, by power iteration on an upper bound of the second derivative
    x, xb, top = np.ones(size), 1.0, 1.0
    for _ in range(30):
        norm = float(np.sqrt(x @ x + xb * xb))
        x, xb = x / norm, xb / norm
        e = 0.25 * (xb + np.bincount(t, x[p], minlength=n)) / n
        x, xb = np.bincount(p, e[t], minlength=size) + ridge * x + 2 * fairness * swapped(x), float(e.sum())
        top = float(np.sqrt(x @ x + xb * xb))
    rate, weight = 0.9 / (top * max(1.0, positive)), np.where(y == 1, positive, 1.0)
    for step in range(steps):
        m = step / (step + 3)
        lw, lb = w + m * vw, bias + m * vb
        e = (1 / (1 + np.exp(-np.clip(lb + np.bincount(t, lw[p], minlength=n), -40, 40))) - y) * weight
        gw = np.bincount(p, e[t], minlength=size) / n + ridge * lw + 2 * fairness * swapped(lw)
        vw, vb = m * vw - rate * gw, m * vb - rate * e.mean()
        w, bias = w + vw, bias + vb
    return Model(features, w, float(bias))


def train(docs: DataFrame, labels: DataFrame, usable_rows, terms=IDENTITY_TERMS, fairness: float = 1.0, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most sample_rows labelled rows that satisfy usable_rows (a condition on doc_id), those with the smallest hashes of doc_id."""
    store = Store(docs.sparkSession, "toxicity")
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(usable_rows).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    sample = store.keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "sample")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = store.keep(own.join(F.broadcast(sample), "doc_id").select("text", "y"), "texts")  # at most sample_rows rows of 12 bytes are broadcast
    n1, n0 = texts.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    counts = texts.mapInArrow(_count, "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # the chi-squared statistic of having the feature against the label
    n = float(n1 + n0)
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n - a - b + 1e-9) * max(n1, 0.5) * max(n0, 0.5))
    best = counts.where(F.col("n1") + F.col("n0") >= LEAST_TEXTS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(FEATURES).select("feature").collect()
    term_hashes = [[_one_word(x) for x in group] for group in terms]
    mine = {h for group in term_hashes for t in group for h in t if h}
    features = np.array(sorted({r["feature"] & 0xFFFFFFFFFFFFFFFF for r in best} | mine), np.uint64)
    at = {int(h): k for k, h in enumerate(features)}
    swaps = [[[at[h] for h in t if h] for t in group] for group in term_hashes]
    blank = Model(features, np.zeros(len(features)), 0.0)

    @released
    def select(batches):
        for batch in batches:
            for i, j, words in slices(batch.column(0), lower=True):
                t, p = blank.places(words)
                places = np.split(p, np.searchsorted(t, np.arange(1, j - i)))
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes() for x in places], pa.binary()), batch.column(1).slice(i, j - i)], ["places", "y"])

    rows = texts.mapInArrow(select, "places binary, y int").orderBy("y", "places").collect()  # at most sample_rows, and FEATURES places each
    return fit([(np.frombuffer(r["places"], "<i4").astype(np.int64), r["y"]) for r in rows], features, swaps, fairness=fairness)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, tie, score, predicted) of each row of docs, in its whole text; tie is a hash of the text. A null or empty text has the model's bias alone."""
    bounded(docs.sparkSession)

    @released
    def run(batches):
        for batch in batches:
            for i, j, words in slices(batch.column(2), lower=True):
                s = model.scores(words)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "tie", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of()[1], F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, tie long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model predicts to be toxic. Equal rows stay or go together; columns and their names are as they were."""
    store = Store(docs.sparkSession, "toxicity")
    bad = score(docs, model).where("predicted = 1").select(F.coalesce("doc_id", F.lit(NEVER)).alias("doc_id"), "tie", "predicted").distinct()
    whole, suspect, (_, _, flag) = met(docs, store.keep(bad, "toxic"), "predicted")
    return whole.unionByName(suspect.where(F.col(flag).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns)))


def held_out(doc_id) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, by a model of the labelled rows that are not held out.

    Without labelled rows every score is near 0. Repeated rows are scored each; a
    doc_id labelled twice counts as toxic if either label says so. Columns other than
    doc_id and text are ignored.
    """
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
