"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight vector over hashed features serves all grades; ordered thresholds part them:
P(grade > k) = 1 / (1 + exp(threshold_k - score)). The fit is full-batch gradient descent whose
gradients are summed by Spark over the sample's partitions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearweave.llm.bpe_codec import Cache
from hearweave.llm.common import slices, stored, with_columns

#: Labelled rows that are learned from, at most, dealt by a hash of the text's id.
FIT_ROWS = 20_000
#: Hashed features; rounds, step and shrinkage of the fit; partitions of the sample.
BUCKETS, ROUNDS, STEP, SHRINK, PARTS = 1 << 14, 40, 0.3, 1e-4, 12
#: A text is selected if it passes the top threshold with this probability.
SELECTED = 0.5

_WORDS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
#: 1 + log(n) of small counts.
_LOGS = [0.0, *(1 + math.log(n) for n in range(1, 1 << 12))]


_SHAPES = {k: xxhash.xxh64_intdigest(f"s a{k}") for k in ("", ",", ".")}
_PLAIN = frozenset(_SHAPES.values())


def _token(token: str) -> tuple[tuple[int, ...], int, int]:
    """The hashes of a token's words and of its shape, and its letters."""
    word, mark = (token, "") if token.isalpha() else (token[:-1], token[-1])
    if mark in _SHAPES and word.isalpha() and (low := word.lower()).isalpha():
        return (xxhash.xxh64_intdigest("w " + low),), _SHAPES[mark], len(low)
    words = _WORDS.findall(token.lower())
    shape = _WORDS.sub("a", _DIGITS.sub("0", token))[:8]
    return tuple(xxhash.xxh64_intdigest("w " + w) for w in words), xxhash.xxh64_intdigest("s " + shape), sum(map(len, words))


class Features:
    """Numbers and values of texts' hashed features; the values have length one.

    Words and the shapes of tokens are counted by logarithm; size, share of letters, repetition and
    line length are graded marks. What a token gives is worked out once and kept (Cache). Half of the
    hashes count with a minus.
    """

    def __init__(self):
        self.tokens = Cache(_token)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        tokens = text.split()
        counted = Counter(tokens)
        kinds: dict[int, int] = {}
        shapes: dict[int, int] = {}
        letters = 0
        get = self.tokens.__getitem__
        for token, n in counted.items():
            words, shape, size = get(token)
            letters += n * size
            shapes[shape] = shapes.get(shape, 0) + n
            for w in words:
                kinds[w] = kinds.get(w, 0) + n
        marks = sum(n for s, n in shapes.items() if s not in _PLAIN)
        kinds |= shapes
        part = 1 / math.sqrt(max(1, len(kinds)))
        lines = text.splitlines() or [""]
        graded = (
            ("size", math.log2(len(tokens) + 1)),
            ("letters", 10 * letters / max(1, len(text))),
            ("distinct", 10 * len(counted) / max(1, len(tokens))),
            ("lines", 10 * len(set(lines)) / len(lines)),
            ("length", math.log2(len(text) / len(lines) + 1)),
            ("word", len(text) / max(1, len(tokens))),
            ("marks", 10 * marks / max(1, len(tokens))),
        )
        hashes = [*kinds, *(xxhash.xxh64_intdigest(f"{name} {round(value)}") for name, value in graded)]
        values = [part * (_LOGS[n] if n < len(_LOGS) else 1 + math.log(n)) for n in kinds.values()] + [1.0] * len(graded)
        at, values = np.array(hashes, np.uint64), np.array(values)
        values[at < 1 << 63] *= -1
        at = (at % BUCKETS).astype(np.int64)
        order = np.argsort(at)
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        numbers, values = at[first], np.add.reduceat(values[order], first)
        return numbers, values / max(1e-9, math.sqrt(float(values @ values)))


class Model:
    """Weights and ordered thresholds; grades are 0 to len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k (columns)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))

    def gradient(self, score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Derivatives of the negative log-likelihood by each score, and by the thresholds."""
        tails = np.column_stack([np.ones(len(score)), self.tails(score), np.zeros(len(score))])
        slopes = tails * (1 - tails)
        rows = np.arange(len(score))
        p = np.maximum(tails[rows, grade] - tails[rows, grade + 1], 1e-9)
        by_score = -(slopes[rows, grade] - slopes[rows, grade + 1]) / p
        by_threshold = np.zeros(len(self.thresholds) + 2)
        np.add.at(by_threshold, grade, slopes[rows, grade] / p)
        np.add.at(by_threshold, grade + 1, -slopes[rows, grade + 1] / p)
        return by_score, by_threshold[1:-1]


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Model:
    """Learns from at most rows rows of grades (key, grade from 0 on) outside the held-out part.

    A null grade is no grade; of several for one key the largest holds. Without grades all texts get
    grade 0 of one threshold.
    """
    known = grades.where(~held_out(key) & F.col(key).isNotNull() & F.col("grade").isNotNull()).groupBy(key)
    known = known.agg(F.max("grade").cast("int").alias("grade")).orderBy(F.xxhash64(key), key).limit(rows)
    sample = docs.select(key, text).join(F.broadcast(known), key).select("grade", text).repartition(PARTS)

    def make():
        features = Features()

        def run(texts: list) -> dict:
            made = [features(x) for x in texts]
            return {"numbers": [a for a, _ in made], "values": [b for _, b in made]}

        return run

    sample = stored(with_columns(sample, text, make, "numbers array<int>, values array<double>", (text,)), "sample")
    n = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    total, top = sum(n.values()), max(n, default=0)
    above = [sum(c for g, c in n.items() if g > k) for k in range(max(1, top))]
    start = [math.log((total - a + 1) / (a + 1)) for a in above]
    model = Model(np.zeros(BUCKETS), np.array(start))
    if len(n) < 2:
        return model

    context = docs.sparkSession.sparkContext
    past_w, past_t = np.zeros(BUCKETS), np.zeros(len(start))
    for _ in range(ROUNDS):
        shared = context.broadcast(model)

        def gradients(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            by_w, by_t = np.zeros(BUCKETS), np.zeros(len(m.thresholds))
            for batch in batches:
                lengths = np.diff(batch.column("numbers").offsets.to_numpy())
                numbers, values = batch.column("numbers").flatten().to_numpy(), batch.column("values").flatten().to_numpy()
                owner = np.repeat(np.arange(len(lengths)), lengths)
                score = np.bincount(owner, values * m.weights[numbers], len(lengths))
                by_score, t = m.gradient(score, batch.column("grade").to_numpy().astype(np.int64))
                by_w += np.bincount(numbers, values * by_score[owner], BUCKETS)
                by_t += t
            yield pa.RecordBatch.from_pydict({"w": pa.array([by_w.tolist()]), "t": pa.array([by_t.tolist()])})

        # one row from each of PARTS partitions, however large the input is
        parts = sample.coalesce(PARTS).mapInArrow(gradients, "w array<double>, t array<double>").collect()
        by_w = np.sum([p["w"] for p in parts], axis=0) / total + SHRINK * model.weights
        by_t = np.sum([p["t"] for p in parts], axis=0) / total
        past_w, past_t = 0.9 * past_w + by_w, 0.9 * past_t + by_t
        thresholds = np.maximum.accumulate(model.thresholds - STEP * past_t)
        model = Model(model.weights - 20 * STEP * past_w, thresholds)
        shared.unpersist()
    return model


def grade_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with expected_grade and tail_probability (of the top grade). Null texts are graded as empty
    ones. Rows stay where they are; other columns are kept, those named as the results replaced. Repeated rows are graded each, texts of any length whole; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, features = shared.value, Features()

        def run(texts: list[str | None]) -> dict:
            scores = np.array([float(v @ m.weights[k]) for k, v in map(features, texts)])
            tails = m.tails(scores)
            return {"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, -1].copy()}

        return run

    return with_columns(docs, text, make, "expected_grade double, tail_probability double")


def ratings(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Grades from two marks: 0 for low quality, 1 for good but toxic, 2 for good and clean."""
    good, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labels.select(key, F.when(good == 0, 0).when(good == 1, F.when(toxic == 1, 1).otherwise(2)).alias("grade"))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, held_out, expected_grade, tail_probability, selected."""
    graded = grade_documents(docs.select(key, "text"), fit(docs, ratings(labels, key), key))
    return graded.select(key, held_out(key).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= SELECTED).alias("selected"))
