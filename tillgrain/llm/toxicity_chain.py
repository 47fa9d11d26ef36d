"""Toxicity by a classifier chain.

Categories are predicted one after the other: the linear model of a category
reads, besides the words of the text, the probabilities of the categories before
it. Later models are trained with out-of-fold probabilities, so they meet the
same kind of input in training as in use. Models are fitted on a bounded sample
of labelled rows; every document is scored over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillgrain.llm.common import slices

#: Chain order: the text is junk, it is toxic, it is both.
CATEGORIES = ("junk", "toxic", "toxic_junk")
SAMPLE = 8000
BUCKETS = 1 << 18
#: Hashed words per category that a model may use, and documents a word needs.
WORDS, LEAST_DOCS = 2048, 3
FOLDS = 5
FALSE = 0.25
RIDGE = 2e-4
DENSE = ("log_words", "symbols", "upper", "repeated_lines")
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of the lower-case text, and figures of its form."""
    words = set(_WORD.findall(text.lower()))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in words), np.int32, len(words))
    n, lines = max(1, len(text)), text.split("\n")
    marks = sum(text.count(c) for c in "#*$%&|<>!")
    upper = len(re.findall("[A-Z]", text))
    dense = np.array([np.log1p(text.count(" ")), marks / n, upper / n, 1 - len(set(lines)) / len(lines)])
    return np.unique(hashed), dense


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(words, dense, targets, folds) of at most ``most`` labelled documents, drawn
    by hash of the id. Rows without an id or without both labels are left out; of
    repeated labels the larger counts."""
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    drawn = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("words", pa.list_(pa.int32())), ("dense", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), batch.column("toxic").cast(pa.int32()),
                                   pa.array([w for w, _ in found], pa.list_(pa.int32())), pa.array([d for _, d in found], pa.list_(pa.float64()))], schema=schema)

    got = rows.mapInArrow(run, "doc_id bigint, quality int, toxic int, words array<int>, dense array<double>").orderBy("doc_id").toArrow()
    words = [np.asarray(w, np.int64) for w in got.column("words").to_pylist()]
    dense = np.array(got.column("dense").to_pylist(), float).reshape(len(words), len(DENSE))
    junk, toxic = 1 - got.column("quality").to_numpy(), got.column("toxic").to_numpy()
    targets = np.stack([junk, toxic, junk * toxic], 1).astype(float).reshape(len(words), len(CATEGORIES))
    folds = np.array([xxhash.xxh3_64_intdigest(str(i)) % FOLDS for i in got.column("doc_id").to_pylist()], int)
    return words, dense, targets, folds


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def evidence(hit: np.ndarray, seen: np.ndarray, share: float) -> np.ndarray:
    """Negative logarithm of the chance (Chernoff's bound) that a word that says
    nothing has ``hit`` examples among the ``seen`` documents it is in. It
    means the same however few examples there are."""
    rate = hit / np.maximum(seen, 1)
    part = lambda a, b: a * np.log(np.maximum(a, 1e-12) / b)
    return seen * (part(rate, share) + part(1 - rate, 1 - share))


class Linear:
    """Logistic regression on selected hashed words and dense inputs."""

    def __init__(self, words: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> None:
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        col = np.concatenate(words) if len(words) else np.empty(0, np.int64)
        seen, hit = np.bincount(col, minlength=BUCKETS), np.bincount(col, y[row], BUCKETS)
        share = (y.sum() + 0.5) / (len(y) + 1)
        gain = np.where(seen >= LEAST_DOCS, evidence(hit, seen, share), 0)
        top = np.argsort(-gain, kind="stable")[:WORDS]
        # the most words of which a share of FALSE at most is expected to say nothing
        bound = np.log(max(1, np.count_nonzero(seen >= LEAST_DOCS)) / (FALSE * np.arange(1, len(top) + 1)))
        passed = np.flatnonzero(gain[top] >= bound)
        self.columns = np.sort(top[:passed[-1] + 1] if len(passed) else top[:0])
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        self.word, self.dense, self.bias = np.zeros(len(self.columns)), np.zeros(dense.shape[1]), np.log(share / (1 - share))
        place = np.full(BUCKETS, -1)
        place[self.columns] = np.arange(len(self.columns))
        use = place[col] >= 0
        self._fit(row[use], place[col[use]], (dense - self.mean) / self.scale, y)

    def _fit(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 250) -> None:
        """Adagrad on the whole sample with a ridge penalty."""
        n = len(y)
        sums = [np.full(len(self.word), 1e-8), np.full(len(self.dense), 1e-8), 1e-8]
        for _ in range(rounds):
            z = self.bias + x @ self.dense + np.bincount(row, self.word[col], n)
            error = (sigmoid(z) - y) / n
            grads = [np.bincount(col, error[row], len(self.word)) + RIDGE * self.word, x.T @ error + RIDGE * self.dense, error.sum()]
            for k, g in enumerate(grads):
                sums[k] = sums[k] + g * g
            self.word = self.word - 0.3 * grads[0] / np.sqrt(sums[0])
            self.dense = self.dense - 0.3 * grads[1] / np.sqrt(sums[1])
            self.bias = self.bias - 0.3 * grads[2] / np.sqrt(sums[2])

    def weights(self) -> np.ndarray:
        """Weight of every bucket, most of them 0."""
        out = np.zeros(BUCKETS, np.float32)
        out[self.columns] = self.word
        return out

    def predict(self, words: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        full = self.weights()
        z = np.array([full[w].sum() for w in words]) if len(words) else np.zeros(0)
        return sigmoid(self.bias + z + ((dense - self.mean) / self.scale) @ self.dense)


class Chain:
    """Models of all categories in order, with the threshold of each."""

    def __init__(self, words: list[np.ndarray], dense: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> None:
        self.models, self.thresholds, inputs = [], [], dense
        for c in range(targets.shape[1]):
            y, held = targets[:, c], np.zeros(len(words))
            for f in np.unique(folds):
                a, b = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                if len(a):
                    held[b] = Linear([words[i] for i in a], inputs[a], y[a]).predict([words[i] for i in b], inputs[b])
            self.models.append(Linear(words, inputs, y))
            self.thresholds.append(best_f1(held, y))
            inputs = np.column_stack([inputs, held])

    def predict(self, words: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        for m in self.models:
            dense = np.column_stack([dense, m.predict(words, dense)])
        return dense[:, -len(self.models):]


def best_f1(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold with the best F1; of equals the middle one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(y.sum(), 1))
    at = int(np.argmax(f1))
    return float((p[order][at] + (p[order][at + 1] if at + 1 < len(p) else 0)) / 2)


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text; further columns are ignored) as doc_id, the
    probability of each category and ``toxic``. Without a chain (no labelled rows)
    probabilities are null and nothing is toxic. Null and empty texts score as texts without words;
    repeated rows and null ids are scored like any row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if chain is None:
        return docs.select("doc_id", *[F.lit(None).cast("double").alias(f"p_{c}") for c in CATEGORIES], F.lit(False).alias("toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in CATEGORIES), ("toxic", pa.bool_())])
    threshold, toxic = chain.thresholds[CATEGORIES.index("toxic")], CATEGORIES.index("toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t or "") for t in batch.column("text").to_pylist()]
            p = shared.value.predict([w for w, _ in found], np.array([d for _, d in found]))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, toxic] >= threshold)], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Chain | None:
    """The chain, or None if a category lacks examples of either kind to learn from."""
    words, dense, targets, folds = sample(docs, labels, most)
    if not len(words) or not (0 < targets[:, 1].sum() < len(words)):
        return None
    return Chain(words, dense, targets, folds)


def detect(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Scores of all documents by a chain fitted on the labelled ones."""
    return score(docs, fit(docs, labels, most))
