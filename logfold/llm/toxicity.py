"""Toxicity: a counterfactually regularised classifier.

Features of a text are its distinct words and their beginnings of 4 and 6 characters; a logistic model with an L1
penalty keeps few of them. Each labelled text that names a group is written again with its names of groups swapped for
others of their kind, a few times; the features of the swapped text are taken anew, and the fit penalises the squared
change of the score, so a group's name alone moves no score.

Training reads a bounded, documented sample: the labelled rows with the least hashes, at most ``max_positive`` toxic and
``max_negative`` others. Rows whose crc32 of the id, modulo ``fold``, is 0 are held out and never learned from.
Scoring reads every whole text. Labels, languages, sources and ids are no inputs of a score.

Defined results: null and empty texts get the score of a text without words. Null labels are not learned from, and a
row labelled both ways counts as toxic. Rows that share an id are scored each. Without a toxic or without another
training row all texts score the smoothed share of toxic ones (0.5 without any row). Other columns are ignored.
An empty table returns no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with

#: Names of groups that may stand for each other in a counterfactual, by kind.
IDENTITIES = {
    "religion": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic catholics protestant sikh sikhs",
    "gender": "man woman men women male female boy girl boys girls transgender nonbinary",
    "orientation": "gay lesbian bisexual straight queer heterosexual homosexual",
    "origin": "african american asian european arab latino latina hispanic mexican chinese indian black white immigrant immigrants refugee refugees native",
    "body": "disabled blind deaf autistic old young elderly",
    "gruppe": "muslime christen juden frauen männer schwule lesben ausländer flüchtlinge behinderte türken polen",
    "groupe": "musulmans chrétiens juifs femmes hommes homosexuels lesbiennes étrangers réfugiés handicapés arabes africains",
    "grupo": "musulmanes cristianos judíos mujeres hombres homosexuales lesbianas extranjeros refugiados discapacitados árabes africanos",
}
_KIND = {w: terms for terms in map(str.split, IDENTITIES.values()) for w in terms}
PREFIXES = (4, 6)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Weights of words and of beginnings, and the score of a text that has none of them."""

    bias: float
    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        seen = set(_WORD.findall(text.lower()))
        total = self.bias + sum(self.words[w] for w in seen & self.words.keys())
        if self.starts:
            begun = {w[:n] for n in PREFIXES for w in seen if len(w) >= n}
            total += sum(self.starts[s] for s in begun & self.starts.keys())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def swapped(text: str, turn: int) -> str:
    """The text (lower case) with each name of a group replaced by another of its kind, the same one throughout the text."""

    def other(m: re.Match) -> str:
        terms = _KIND.get(m[0])
        if terms is None:
            return m[0]
        rest = [t for t in terms if t != m[0]]
        return rest[zlib.crc32(f"{turn} {m[0]} {len(text)}".encode()) % len(rest)]

    return _WORD.sub(other, text)


def held_out(doc_id, fold: int = 5):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_negative: int = 4000, swaps: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5) -> pa.Table:
    """``words`` (distinct, lower case), ``toxic`` and ``swapped`` (the words of each swapped text, where the text names a group) of
    the training sample: at most max_positive + max_negative rows."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).dropna().where(~held_out(F.col("doc_id"), fold))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    chosen = marks.where("toxic > 0").orderBy(*order).limit(max_positive).unionByName(marks.where("toxic <= 0").orderBy(*order).limit(max_negative))

    def distinct(text: str) -> list[str]:
        return sorted(set(_WORD.findall(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower() for t in batch.column(1).to_pylist()]
            words = [distinct(t) for t in texts]
            others = [[distinct(swapped(t, k)) for k in range(swaps)] if not _KIND.keys().isdisjoint(w) else [] for t, w in zip(texts, words, strict=True)]
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(words, strings), batch.column(2), pa.array(others, pa.list_(strings))], names=["words", "toxic", "swapped"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return one.select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(run, "words array<string>, toxic int, swapped array<array<string>>").toArrow()


def _matrix(lists: pa.ListArray, vocabularies: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ones of a feature matrix; the features are the vocabularies one after the other."""
    words = lists.flatten()
    row = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(np.asarray(lists.offsets)))
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    rows, cols, base = [], [], 0
    for k, known in zip((0, *PREFIXES), vocabularies, strict=True):
        long = lengths >= k
        some = pc.utf8_slice_codeunits(words.filter(pa.array(long)), 0, k) if k else words
        at = pc.fill_null(pc.index_in(some, known), -1).to_numpy()
        pairs = np.unique((row[long] * len(known) + at)[at >= 0]) if len(known) else np.zeros(0, np.int64)
        rows.append(pairs // max(1, len(known)))
        cols.append(pairs % max(1, len(known)) + base)
        base += len(known)
    return np.concatenate(rows), np.concatenate(cols)


def _vocabularies(lists: pa.ListArray, least_rows: int) -> list[pa.Array]:
    """Words and their beginnings that this many rows hold, per kind of feature."""
    words = lists.flatten()
    lengths = pc.utf8_length(words)
    every = [words.unique(), *(pc.utf8_slice_codeunits(words.filter(pc.greater_equal(lengths, k)), 0, k).unique() for k in PREFIXES)]
    _, cols = _matrix(lists, every)
    often, base = np.bincount(cols, minlength=sum(map(len, every))) >= least_rows, 0
    found = []
    for some in every:
        found.append(some.filter(pa.array(often[base : base + len(some)])))
        base += len(some)
    return found


def fit(table: pa.Table, swap_penalty: float = 20.0, sparsity: float = 4e-4, least_rows: int = 5, steps: int = 300) -> Model:
    """The model of a training sample, by accelerated proximal gradient steps.

    Beside the mean loss stands ``swap_penalty`` times the mean over all rows of the squared change of the score under a swap.
    """
    y = np.asarray(table.column("toxic").to_numpy() > 0, float)
    n, positive = len(y), float(y.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if not 0 < positive < n:
        return Model(bias)
    lists, swaps = table.column("words").combine_chunks(), table.column("swapped").combine_chunks()
    known = _vocabularies(lists, least_rows)
    width = sum(map(len, known))
    rows, cols = _matrix(lists, known)
    # Counterfactuals: which row each swapped text was made from, its weight, and its features.
    times = np.diff(np.asarray(swaps.offsets))
    origin = np.repeat(np.arange(n), times)
    mass = 1.0 / times[origin]
    swap_rows, swap_cols = _matrix(swaps.flatten(), known)
    smooth = 0.25 * len(rows) / n / 4 + 0.25
    if len(origin):
        smooth += swap_penalty * (len(swap_rows) / len(origin)) * float(mass.sum()) / n / 8
    step = 1.0 / smooth
    w, v, b, vb, t = np.zeros(width), np.zeros(width), bias, bias, 1.0
    last = np.inf
    for _ in range(steps):
        p = _sigmoid(np.bincount(rows, weights=v[cols], minlength=n) + vb)
        error = (p - y) / n
        loss = float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean() + sparsity * np.abs(v).sum())
        other = np.zeros(0)
        if len(origin):
            q = _sigmoid(np.bincount(swap_rows, weights=v[swap_cols], minlength=len(origin)) + vb)
            change = p[origin] - q
            loss += swap_penalty / n * float((mass * change**2).sum())
            pull = 2 * swap_penalty / n * mass * change
            error += np.bincount(origin, weights=pull, minlength=n) * p * (1 - p)
            other = -pull * q * (1 - q)
        gradient = np.bincount(cols, weights=error[rows], minlength=width)
        if len(origin):
            gradient += np.bincount(swap_cols, weights=other[swap_rows], minlength=width)
        if loss > last:  # the momentum overshot
            step, t, v, vb = step * 0.7, 1.0, w.copy(), b
            last = np.inf
            continue
        last = loss
        moved = v - step * gradient
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity, 0)
        new_b = vb - step * float(error.sum() + other.sum())
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    model = Model(b)
    names = [(part, x) for part, some in enumerate(known) for x in some.to_pylist()]
    for i in np.nonzero(w)[0]:
        part, x = names[i]
        (model.words if part == 0 else model.starts)[x] = float(w[i])
    return model


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row. The model is as small as its bounded sample and travels with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema_with(picked.select("doc_id"), "score double"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5, **sizes) -> DataFrame:
    """``doc_id, held_out, score, predicted``: a model learned from the labelled rows that are not held out, applied to all."""
    model = fit(sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, fold=fold, **sizes))
    scored = score(docs, model, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id"), fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
