"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased text, in which all but letters are spaces; they
are hashed into ``FEATURES`` columns.  Term weights are log(1 + count) times the inverse document
frequency, which comes from all training documents; rows have unit length.  The weights are fitted
by follow-the-regularised-leader with an elastic-net penalty on a bounded sample of labelled rows
(``SAMPLE_ROWS`` in all, the same share for each label and one row at least: those with the least hashes of doc_id and text);
a fifth of the sample is left out to calibrate the temperature of the softmax.

Every label is learned, however many there are and however rare.  The model has a weight for each column and label:
with more than ``MODEL_CELLS / FEATURES`` labels the columns are folded to fewer, ``LEAST_FEATURES`` at least.

Edge cases: null, empty and letterless texts are `und` with score 0; null labels are not learned
from; without any labelled row all is `und`; repeated rows give equal results; a null doc_id is
never learned from and counts as held out; an empty table gives an empty result; texts are read
whole; other columns are ignored by ``identify`` and kept as they are by ``keep_known``.  Rows of the same doc_id
and text count once in the sample, however many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Workspace
from .common import LONG_ROWS, crc_mod, id_and_text, map_arrow, without_rows

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled rows that the weights are fitted on, or one of each label if these are more.
SAMPLE_ROWS = 6000
#: Weights of a model; only with more than MODEL_CELLS / LEAST_FEATURES labels there are more.
MODEL_CELLS, LEAST_FEATURES = 1 << 24, 1 << 10
#: One document in so many is left out of training.
FOLDS = 5
#: A pipeline keeps predictions from this calibrated score on with four languages, where chance is 0.25.
LEAST_SCORE = 0.4
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
#: Odd multipliers for the hash of n-grams, one for each position.
_FACTORS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
_SALTS = {1: 0x9E3779B1, 2: 0x85EBCA77, 3: 0xC2B2AE3D}

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of a text and how often each occurs; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    hashed = []
    for order in ORDERS:
        n = len(codes) - order + 1
        h = np.full(n, _SALTS[order], dtype=np.uint32)
        for j in range(order):
            h = (h ^ codes[j : j + n]) * _FACTORS[j]
            h ^= h >> np.uint32(15)
        hashed.append(h & np.uint32(FEATURES - 1))
    found = np.bincount(np.concatenate(hashed), minlength=FEATURES)
    at = np.flatnonzero(found)
    return at.astype(np.uint16), found[at].astype(np.uint32)


def features_for(labels: int) -> int:
    """Columns of a model with so many labels: a power of two."""
    features = FEATURES
    while features > LEAST_FEATURES and features * labels > MODEL_CELLS:
        features //= 2
    return features


class Model:
    """Weights by label and feature, inverse document frequencies and the temperature."""

    def __init__(self, labels: list[str], seen: np.ndarray, docs: int):
        """seen: in how many of so many documents each feature occurs."""
        self.labels, self.features = labels, features_for(len(labels))
        folded = np.minimum(docs, seen.reshape(-1, self.features).sum(axis=0))
        self.idf = (np.log((1 + docs) / (1 + folded)) + 1).astype(np.float32)
        self.weights = np.zeros((self.features, len(labels)), dtype=np.float32)
        self.temperature = 1.0

    def folded(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and counts, for a model with fewer columns than there are features."""
        if self.features == FEATURES:
            return at, n
        sums = np.bincount(at % self.features, weights=n, minlength=self.features)
        at = np.flatnonzero(sums)
        return at, sums[at]

    def row(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[at]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.row(at, n) @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text)
        if found is None or not self.labels:
            return "und", 0.0
        p = _softmax(self.logits(*self.folded(*found)) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seen: np.ndarray, docs: int) -> Model:
    """rows: label, features, counts. Every fifth row is kept for the temperature, but for the first of its label."""
    model = Model(sorted({label for label, _, _ in rows}), seen, docs)
    if len(model.labels) < 2:
        return model
    number = {label: i for i, label in enumerate(model.labels)}
    rows = [(label, *model.folded(at, n)) for label, at, n in rows]
    firsts = set({label: i for i, (label, _, _) in reversed(list(enumerate(rows)))}.values())
    train, rest = [r for i, r in enumerate(rows) if i % 5 or i in firsts], [r for i, r in enumerate(rows) if not i % 5 and i not in firsts]
    z, n = (np.zeros((model.features, len(model.labels))) for _ in range(2))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(0, np.abs(z) - L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(train)):
            label, at, count = train[i]
            x, own_z, own_n = model.row(at, count), z[at], n[at]
            w = weights(own_z, own_n)
            p = _softmax(x @ w)
            p[number[label]] -= 1
            g = x[:, None] * p
            z[at] = own_z + g - (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA * w
            n[at] = own_n + g * g
    model.weights = weights(z, n).astype(np.float32)

    if rest:
        scores = np.array([model.logits(at, count) for _, at, count in rest], dtype=np.float64)
        truth = np.array([number[label] for label, _, _ in rest])

        def loss(log_t: float) -> float:
            p = _softmax(scores / np.exp(log_t))[np.arange(len(truth)), truth]
            return float(-np.log(np.maximum(p, 1e-12)).mean())

        low, high = -3.0, 3.0
        for _ in range(60):  # the loss has one minimum in the temperature
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


GATHERED = "label string, hash long, at binary, n binary, docs long, seen binary"
_KINDS = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]


def train(docs: DataFrame, work: Workspace, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on rows with text and lang; only these are read."""
    labelled = docs.where("text is not null and lang is not null and doc_id is not null")
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("hash"))
    # different rows, so that one many times repeated takes no other's place
    sizes = work.save(labelled.groupBy("lang").agg(F.approx_count_distinct("hash").alias("size")))
    each = max(1, -(-sample_rows // max(1, sizes.count())))
    # some more than needed, as a hash gives now more, now fewer; these alone are ranked
    some = 1.2 * each + 6 * each**0.5 + 16
    chosen = F.shiftrightunsigned("hash", 34) * F.col("size") < some * (1 << 30)
    def gather(batches):
        """The sample's rows, and at the end in how many texts of this task each feature occurs."""
        docs_read, seen, taken = 0, np.zeros(FEATURES, dtype=np.int64), set()
        for batch in batches:
            rows = []
            for text, lang, number, take in zip(*(batch.column(k).to_pylist() for k in ("text", "lang", "hash", "chosen"))):
                if found := counts(text):
                    docs_read += 1
                    seen[found[0]] += 1
                    if take and (lang, number) not in taken:
                        taken.add((lang, number))
                        rows.append((lang, number, found[0].tobytes(), found[1].tobytes(), None, None))
            yield _gathered(rows)
        yield _gathered([(None, None, None, None, docs_read, seen.tobytes())])

    def added(batches):
        """Adds up the last rows of the tasks; passes the sample's rows on."""
        docs_read, seen = 0, np.zeros(FEATURES, dtype=np.int64)
        for batch in batches:
            for n, data in zip(batch.column("docs").to_pylist(), batch.column("seen").to_pylist()):
                docs_read, seen = docs_read + n, seen + np.frombuffer(data, np.int64)
        yield _gathered([(None, None, None, None, docs_read, seen.tobytes())])

    gathered = work.save(map_arrow(labelled.join(sizes, "lang").select("text", "lang", "hash", chosen.alias("chosen")), gather, GATHERED))
    least = Window.partitionBy("label").orderBy("hash")
    once = gathered.where("label is not null").groupBy("label", "hash").agg(F.first("at").alias("at"), F.first("n").alias("n"))
    ranked = once.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= each)
    sample = ranked.select("label", "at", "n").toArrow().to_pylist()
    # however many tasks there were, sixteen vectors reach the driver
    sums = map_arrow(gathered.where("docs is not null").repartition(16), added, GATHERED).select("docs", "seen").collect()
    n_docs = sum(r["docs"] for r in sums)
    seen = sum((np.frombuffer(r["seen"], np.int64) for r in sums), np.zeros(FEATURES, np.int64))
    rows = sorted((r["label"], bytes(r["at"]), bytes(r["n"])) for r in sample)
    order = np.random.default_rng(0).permutation(len(rows))
    return fit([(rows[i][0], np.frombuffer(rows[i][1], np.uint16), np.frombuffer(rows[i][2], np.uint32)) for i in order], seen, n_docs)


def _gathered(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS)], names=["label", "hash", "at", "n", "docs", "seen"])


def apply(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted label and its score to a table with a text column; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # about MODEL_CELLS weights
    docs = docs.drop(label, score)
    kept = docs.schema.fieldNames()

    def predict(batches):
        model = sent.value
        for batch in batches:
            found = [model.predict(text) for text in batch.column("text").to_pylist()]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, label, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    return map_arrow(docs, predict, schema)


def learned_from(folds: int = FOLDS):
    """Rows of fold 0, and rows without a doc_id, are not learned from."""
    return F.coalesce(crc_mod("doc_id", folds) != 0, F.lit(False))


def least_known(labels: int) -> float:
    """The bound of ``keep_known``: as far from chance to certainty as LEAST_SCORE is with four labels."""
    chance = 1 / max(1, labels)
    return chance + (1 - chance) * (LEAST_SCORE - 0.25) / 0.75


def keep_known(docs: DataFrame, least_score: float | None = None, work: Workspace | None = None) -> DataFrame:
    """The documents, with all their columns, whose language is known; text without letters is rejected.

    If no labelled row can be learned from, only text without letters is rejected. The bound follows
    the number of labels unless it is given.
    """
    work = work or Workspace(docs.sparkSession, "langid", LONG_ROWS)
    model = train(docs.where(learned_from()), work)
    if not model.labels:
        return without_rows(docs, lambda rows: map_arrow(rows, _letterless, "file long, row long"), work)
    if least_score is None:
        least_score = least_known(len(model.labels)) - 1e-9  # the last digit is rounding
    unknown = (F.col("lang_pred") == "und") | (F.col("score") < least_score)
    return without_rows(docs, lambda rows: apply(rows, model).where(unknown), work)


def _letterless(batches):
    for batch in batches:
        kept = batch.filter(pa.array([counts(text) is None for text in batch.column("text").to_pylist()], pa.bool_()))
        yield kept.select(["file", "row"])


def identify(docs: DataFrame, folds: int = FOLDS, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Rows of fold 0 are not learned from."""
    work = work or Workspace(docs.sparkSession, "langid", LONG_ROWS)
    model = train(docs.where(learned_from(folds)), work)
    rows = id_and_text(docs, (~learned_from(folds)).alias("held_out"))
    return work.save(apply(rows, model).select("doc_id", "held_out", "lang_pred", "score"))
