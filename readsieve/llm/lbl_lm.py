"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Tokens are the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and one end token per text.

Statistics cover all training documents: the count of every token, of every pair of token classes
one, two and three places apart, and, for each word, of the classes before and after it.  The
``OWN_CLASSES`` most frequent words have a class each, the end token has one, and all other words
share ``SUFFIX_CLASSES`` by a hash of their last two bytes.  What is before a text is the end token.

The log-bilinear model predicts the embedding of the next class from three places of context, each
with a linear map of its own.  Noise-contrastive estimation tells the observed classes from noise; as
contexts are counted, the expectation over noise is taken exactly, by matrix products over all
classes.  First the place before is fitted, against noise of the classes' frequencies; then the two
places before that, against noise of what has been fitted.  For these two the classes are clustered
by the embeddings they have there (``GROUPS`` learned groups for each place), so that the sum over
classes that normalises a prediction can be kept in tables: of word or class, and pair of groups.

Every word of a shared class, however rare, then gets two embeddings of its own, so the model grows
with the vocabulary.  With h the word before w, j and k their classes, and g, g' the groups before h,

    P(w | h, g, g') = P(k | j) exp((own input of h + g + g') . k) / Z(h, g, g')  x  (c(w)+1) exp(own output of w . j) / Z(k, j)

Both are fitted by NCE on the contexts observed of that word, against noise with the contexts of its
class; a Gaussian prior draws the rare ones to their class.  Every word takes one step, which can't
overshoot, and words seen ``MORE_STEPS_FROM`` times or more take ``OWN_STEPS`` accelerated steps.
Z(h, g, g') sums over all classes and Z(k, j) over all words of class k and one unseen word, so
probabilities of words add up to 1.

What is still merged: an embedding of a word's own meets the class of its neighbour, not the neighbour
itself, if that has no class of its own; two and three places back only groups of classes count; an
unseen word has its class's.

Parameters of the ``HEAD_WORDS`` most frequent words are broadcast.  Of all others the occurrences of
a word are gathered, and its embeddings fitted where they are used, if there are at most ``GATHERED``
(of learned texts, and of others).  Words with more are fitted from counts of the classes beside
them, at most 2 x ``CLASSES`` a word, and the parameters joined to their occurrences, so that no row or
task has all of these.  Words of over ``LONGEST_WORD`` bytes go by a 128-bit digest.

Edge cases: null and empty texts consist of the end token; without training documents every count
is 0 and classes are equally likely; repeated rows are scored each on its own; a null doc_id is
not learned from and counts as held out; an empty table gives an empty result; texts are scored
whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .common import LONG_ROWS, crc_mod, id_and_text, map_arrow, text_bytes

#: Words whose counts are broadcast.
HEAD_WORDS = 100_000
#: Bytes of a word that stands for itself.
LONGEST_WORD = 100
#: Occurrences of a word beyond the head that are gathered, of learned texts and of others.
GATHERED = 20_000
OWN_CLASSES, SUFFIX_CLASSES = 383, 128
CLASSES = 1 + OWN_CLASSES + SUFFIX_CLASSES  # class 0: the end token
DIMENSION, NOISE, STEPS, RATE = 32, 10, 150, 0.05
#: Groups of classes at the second and at the third place back, and the steps that fit these places.
GROUPS, FAR_STEPS = 6, 100
#: Bytes of text that are encoded together, and those whose words are looked up together.
ENCODED_TOGETHER, SPLIT_TOGETHER = 500_000, 2_000_000
#: Distinct words, and bytes of text, that a task counts before it hands them on.
COUNTED_TOGETHER, BYTES_TOGETHER = 300_000, 128_000_000
#: Precision of the prior of own embeddings, whose features have unit variance.
PRIOR = 8.0
MORE_STEPS_FROM, OWN_STEPS = 16, 12
#: Words whose scores against all classes are held at once.
FITTED_TOGETHER = 500
#: Counts are binned by eighths of a power of two to find the head.
BINS_PER_DOUBLING = 8
#: Neighbours of the head's words that a task holds before it adds them up.
NEIGHBOURS_TOGETHER = 1_000_000
END = b" "  # no word holds a space
# Of each byte, whether words hold it.
_IN_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def split_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of texts one after the other, and how many each text has; no object is made for a word."""
    data = np.frombuffer(b" ".join([text or b"" for text in texts]).lower(), np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside[1:-1]])])
    upto = np.cumsum([len(text or b"") + 1 for text in texts])
    return words, np.diff(np.searchsorted(starts, upto), prepend=0)


def _objects(column: pa.Array) -> list:
    """As ``to_pylist``, which makes a scalar of each value first."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _floats(column: pa.Array) -> np.ndarray:
    """The float32 values that the rows of a binary column hold, a row for each; as many in all."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(len(column), -1)


def _together(texts: list[bytes | None], size: int):
    """Bounds of stretches of texts, each of ``size`` bytes or the first that go beyond."""
    first, held = 0, 0
    for last, text in enumerate(texts, 1):
        held += len(text or b"")
        if held >= size or last == len(texts):
            yield first, last
            first, held = last, 0


def stand_in(word: bytes) -> bytes:
    """A long word's digest, after a space, which no word holds, and before the word's last two bytes, which tell its class."""
    return b" " + hashlib.blake2b(word, digest_size=16).digest() + word[-2:] if len(word) > LONGEST_WORD else word


@functools.cache  # of two bytes at most
def _suffix(end: bytes) -> int:
    return zlib.crc32(end) % SUFFIX_CLASSES


def suffix_class(word: bytes) -> int:
    return 1 + OWN_CLASSES + _suffix(word[-2:])


@functools.cache
def _suffix_table() -> np.ndarray:
    """By the byte before a word's last, 256 if there is none, and by its last byte."""
    return np.array([[_suffix(bytes([a, b] if a < 256 else [b])) for b in range(256)] for a in range(257)])


def suffixes(words: pa.Array) -> np.ndarray:
    """Of each word what ``_suffix`` says of its last two bytes."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = words.cast(pa.large_binary())
    _, offsets, letters = words.buffers()
    offsets, letters = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1], np.frombuffer(letters, np.uint8).astype(np.int64)
    ends = offsets[1:]
    return _suffix_table()[np.where(np.diff(offsets) > 1, letters[np.maximum(ends - 2, 0)], 256), letters[ends - 1]]


def suffix_classes(words: pa.Array) -> np.ndarray:
    return suffixes(words) + 1 + OWN_CLASSES


def _count_words(batches):
    found: dict[bytes, int] = {}

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([w if len(w) <= LONGEST_WORD else stand_in(w) for w in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    held = 0
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for first, last in _together(texts, SPLIT_TOGETHER):
            counted = split_words(texts[first:last])[0].value_counts()
            for word, n in zip(_objects(counted.field("values")), counted.field("counts").to_numpy().tolist()):
                found[word] = found.get(word, 0) + n
            found[END] = found.get(END, 0) + last - first
            held += sum(len(text or b"") for text in texts[first:last])
            if len(found) > COUNTED_TOGETHER or held > BYTES_TOGETHER:
                yield rows()
                found.clear()
                held = 0
    if found:
        yield rows()


class Vocabulary:
    """The head's words with their counts and classes, and the totals of each class."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, by_suffix: dict[int, tuple[int, int]]):
        """head: by descending count. by_suffix: of all words but the end token, count and number."""
        self.total, self.distinct = total, distinct
        counts = dict(head)
        self.end_count = counts.pop(END, 0)
        self.words = {word: i for i, word in enumerate(counts)}
        self.listed = pa.array(list(counts), pa.large_binary())
        self.counts = np.array(list(counts.values()), dtype=np.float64)
        of_word = [1 + i if i < OWN_CLASSES else suffix_class(word) for word, i in self.words.items()]
        self.classes = np.array(of_word, dtype=np.int64)
        totals = np.zeros((CLASSES, 2))
        for suffix, (n, words) in by_suffix.items():
            totals[1 + OWN_CLASSES + suffix] = n, words
        for word, i in self.words.items():
            if i < OWN_CLASSES:
                totals[suffix_class(word)] -= self.counts[i], 1
        #: log10 of N+V+1 within a class; 0 where the class is one word
        self.class_total = np.where(np.arange(CLASSES) > OWN_CLASSES, np.log10(np.maximum(1, totals.sum(axis=1) + 1)), 0)

    def encode(self, texts: list[bytes | None]):
        """Encoded tokens of some texts at a time."""
        for first, last in _together(texts, SPLIT_TOGETHER):
            some = texts[first:last]
            words, n = split_words(some)
            at = pc.fill_null(pc.index_in(words, value_set=self.listed), -1).to_numpy()
            before = np.concatenate([[0], np.cumsum(n)]).tolist()
            for a, b in _together(some, ENCODED_TOGETHER):
                yield Encoded(self, words[before[a] : before[b]], at[before[a] : before[b]], n[a:b])


class Encoded:
    """Tokens of texts one after the other, each text with its end token.

    at: position in the head, -1 elsewhere. kind: class. ends, missing: places of end tokens, and of
    words beyond the head, which are ``others``. starts: where each text begins.
    """

    def __init__(self, voc: Vocabulary, words: pa.Array, at: np.ndarray, n: np.ndarray):
        """words: of all texts, with their positions in the head. n: how many each text has."""
        self.sizes = n + 1
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.ends = self.starts + n
        places = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
        self.at = np.full(len(words) + len(n), -1, dtype=np.int64)
        self.at[places] = at
        missing = at < 0
        self.missing = places[missing]
        self.others = words.filter(pa.array(missing)).cast(pa.binary())
        suffix = suffixes(self.others)
        if (pc.max(pc.binary_length(self.others)).as_py() or 0) > LONGEST_WORD:
            rest = list(map(stand_in, self.rest))
            self.at[self.missing] = found = np.array([voc.words.get(w, -1) for w in rest])
            self.others = pa.array([w for w, i in zip(rest, found.tolist()) if i < 0], pa.binary())
            self.missing, suffix = self.missing[found < 0], suffix[found < 0]
        self.kind = voc.classes[self.at] if len(voc.classes) else np.zeros(len(self.at), np.int64)
        self.kind[self.ends] = 0
        self.kind[self.missing] = suffix + 1 + OWN_CLASSES
        self.place = np.arange(len(self.at)) - np.repeat(self.starts, self.sizes)

    @property
    def rest(self) -> list[bytes]:
        return self.others.to_pylist()

    def before(self, places: int) -> np.ndarray:
        """The classes so many places back; 0 before a text."""
        return self.earlier(self.kind, places, 0)

    def earlier(self, values: np.ndarray, places: int, other: int) -> np.ndarray:
        out = np.full(len(values), other, dtype=values.dtype)
        out[places:] = values[:-places]
        out[self.place < places] = other
        return out

    def after(self) -> np.ndarray:
        return np.append(self.kind[1:], 0)

    def by_text(self, values: np.ndarray, where=slice(None)) -> np.ndarray:
        """Sums by text of values of the tokens ``where``."""
        whole = np.zeros(len(self.at))
        whole[where] = values
        return np.add.reduceat(whole, self.starts)


def _suffix_column():
    return F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(SUFFIX_CLASSES))


def learn_vocabulary(counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """counts: word, c, of all training tokens. Gives the counts of words beyond the head as well."""
    bin_of = F.floor(F.log2("c") * BINS_PER_DOUBLING)
    bins = counts.groupBy(bin_of.alias("bin"), _suffix_column().alias("suffix"), (F.col("word") == F.lit(END)).alias("end"))
    bins = bins.agg(F.count("*").alias("words"), F.sum("c").alias("n")).collect()  # at most 64 x 8 x SUFFIX_CLASSES rows
    least, words = math.inf, 0
    for b in sorted({r["bin"] for r in bins}, reverse=True):
        words += sum(r["words"] for r in bins if r["bin"] == b)
        if words > HEAD_WORDS:
            break
        least = b
    in_head = (bin_of >= least) | (F.col("word") == F.lit(END))
    head = counts.where(in_head).select("word", "c").toArrow() if bins else None
    pairs = [] if head is None else sorted(zip(map(bytes, head.column("word").to_pylist()), head.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))
    by_suffix: dict[int, tuple[int, int]] = {}
    for r in bins:
        if not r["end"]:
            n, k = by_suffix.get(r["suffix"], (0, 0))
            by_suffix[r["suffix"]] = (n + r["n"], k + r["words"])
    return Vocabulary(pairs, sum(r["n"] for r in bins), sum(r["words"] for r in bins), by_suffix), counts.where(~in_head)


def _logistic(x: np.ndarray) -> np.ndarray:
    """Without overflow: beyond 60 either way it is 0 or 1 in float32."""
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(pairs: np.ndarray) -> np.ndarray:
    """pairs: how often class w (column) follows class h (row). Gives log10 P(w | h), normalised."""
    return train_classes(pairs)[0]


def train_classes(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``train``, and besides the predicted embedding after each class, and the target embeddings."""
    total = max(1.0, pairs.sum())
    noise = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
    observed, context = pairs / total, pairs.sum(axis=1, keepdims=True) / total
    rng = np.random.default_rng(0)
    own = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    target, given, turn = own(CLASSES, DIMENSION), own(CLASSES, DIMENSION), np.eye(DIMENSION, dtype=np.float32)
    bias = np.log(noise).astype(np.float32)
    parameters = [target, given, turn, bias]
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    log_noise = np.log(NOISE * noise).astype(np.float32)
    observed, contrast = observed.astype(np.float32), (NOISE * context * noise).astype(np.float32)
    weight = (1 / np.maximum(context, 1e-7)).astype(np.float32) ** 0.5  # rare contexts learn as well
    for step in range(1, STEPS + 1):
        predicted = given @ turn
        score = predicted @ target.T + bias
        real = _logistic(score - log_noise)  # probability that a pair is data, not noise
        slope = (observed * (1 - real) - contrast * real) * weight
        back = slope @ target
        slopes = [slope.T @ predicted, back @ turn.T, given.T @ back, slope.sum(axis=0)]
        for p, g, m, v in zip(parameters, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += RATE * (1 - step / STEPS * 0.9) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    score = (given @ turn) @ target.T + bias
    score = score.astype(np.float64)
    score -= score.max(axis=1, keepdims=True)
    log_p = ((score - np.log(np.exp(score).sum(axis=1, keepdims=True))) / math.log(10)).astype(np.float32)
    return log_p, given @ turn, target


class Side:
    """Fits own embeddings of words on one side: to the classes before them, or after them."""

    def __init__(self, features: np.ndarray, reference: np.ndarray):
        """features: of all classes as neighbours. reference: P(neighbour's class | own class), by row."""
        weight = reference.mean(axis=0, dtype=np.float64)
        x = features - weight @ features
        values, axes = np.linalg.eigh((x * weight[:, None]).T @ x)
        self.features = (x @ axes / np.sqrt(np.maximum(values, 0) + 1e-3 * max(float(values.mean()), 1e-12))).astype(np.float32)
        self.reference = reference.astype(np.float32)
        self.mean = self.reference @ self.features
        self.spread = np.array([np.linalg.eigvalsh((self.features * r[:, None]).T @ self.features)[-1] for r in self.reference], dtype=np.float32)
        self.length = (self.features**2).sum(axis=1)

    def fit(self, kind: np.ndarray, starts: np.ndarray, near: np.ndarray, n: np.ndarray) -> np.ndarray:
        """kind: the words' classes. near, n: neighbours' classes and counts; those of word i begin at starts[i], at least one."""
        n = n.astype(np.float32)
        c = np.add.reduceat(n, starts)
        real = 1 / (1 + NOISE)  # of a pair that scores as its class does
        slope = (1 - real) * (np.add.reduceat(self.features[near] * n[:, None], starts) - c[:, None] * self.mean[kind])
        # a logistic curve bends by a quarter at most: no step of this length overshoots
        bend = (c / 4 * (NOISE * self.spread[kind] + np.maximum.reduceat(self.length[near], starts)) + PRIOR)[:, None]
        own = slope / bend
        often = np.flatnonzero(c >= MORE_STEPS_FROM)
        ends = np.append(starts[1:], len(near))
        for i in range(0, len(often), FITTED_TOGETHER):
            some = often[i : i + FITTED_TOGETHER]
            observed = np.zeros((len(some), len(self.features)), dtype=np.float32)
            for row, word in zip(observed, some):
                np.add.at(row, near[starts[word] : ends[word]], n[starts[word] : ends[word]])
            noise = NOISE * c[some, None] * self.reference[kind[some]]
            own[some] = self.steps(own[some], observed, noise, bend[some], OWN_STEPS)
        return own

    def steps(self, own: np.ndarray, observed: np.ndarray, noise: np.ndarray, bend: np.ndarray, n: int) -> np.ndarray:
        """n accelerated steps; rows of observed and of noise: counts of neighbours' classes."""
        u = ahead = own
        both = observed + noise
        for step in range(1, n):
            x = ahead @ self.features.T
            np.subtract(math.log(NOISE), x, out=x)
            np.clip(x, -60, 60, out=x)
            np.exp(x, out=x)
            x += 1
            np.divide(both, x, out=x)  # times the probability that a pair is data, not noise
            np.subtract(observed, x, out=x)
            new = ahead + (x @ self.features - PRIOR * ahead) / bend
            ahead = new + (step - 1) / (step + 2) * (new - u)
            u = new
        return u

    def fit_counts(self, observed: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """Embeddings from dense counts; the rows of noise add up to NOISE times those of observed."""
        count = observed.sum(axis=1, keepdims=True)
        bend = count / 4 * (1 + NOISE) * self.length.max() + PRIOR
        return self.steps(np.zeros((len(observed), DIMENSION), np.float32), observed, noise, bend, FAR_STEPS)


def grouped(points: np.ndarray, weight: np.ndarray, n: int = GROUPS) -> np.ndarray:
    """The group of each point, by weighted k-means; it begins with points far from each other."""
    centres = points[[int(weight.argmax())]]
    while len(centres) < n:
        far = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.concatenate([centres, points[[int((far * weight).argmax())]]])
    for _ in range(20):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(n):
            if weight[own == k].sum() > 0:
                centres[k] = np.average(points[own == k], axis=0, weights=weight[own == k])
    return own


class Model:
    """The classes' model, and what fits the words' own embeddings."""

    def __init__(self, pairs: np.ndarray, second: np.ndarray | None = None, third: np.ndarray | None = None):
        """Counts of class w (column) so many places after class h (row); without the last two these places say nothing."""
        self.log_p, predicted, target = train_classes(pairs)
        context = (pairs.sum(axis=1) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
        before = pairs.T + context
        self.before = Side(predicted, before / before.sum(axis=1, keepdims=True))
        after = 10.0 ** self.log_p.astype(np.float64)
        self.after = Side(target, after / after.sum(axis=1, keepdims=True))
        #: of the second and third place: the group of each class there, and what each group adds to the score of each class
        self.group, self.far = zip(*(self._place(seen, between) for seen, between in ((second, pairs), (third, second))))
        both = np.repeat(self.far[0], GROUPS, axis=0) + np.tile(self.far[1], (GROUPS, 1))
        self.shift = both.astype(np.float32)  # by pair of groups
        self.lifted = np.exp(both).T.astype(np.float32)
        self.class_z = np.log(self.after.reference @ self.lifted).astype(np.float32)

    def _place(self, seen: np.ndarray | None, between: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """seen: the classes after a class at this place. between: those that then stand just before them."""
        if seen is None or not seen.sum():
            return np.zeros(CLASSES, np.int64), np.zeros((GROUPS, CLASSES))
        # what the place before predicts, whose class is 0 at the beginning of a text only
        expected = between[:, 1:] @ self.after.reference[1:].astype(np.float64)
        expected[0] += seen[:, 0].sum() * self.after.reference[0]
        expected *= seen.sum(axis=1, keepdims=True) / np.maximum(1e-9, expected.sum(axis=1, keepdims=True))
        weight = seen.sum(axis=1)
        group = grouped(self.after.fit_counts(seen, NOISE * expected), weight)
        observed, noise = np.zeros((GROUPS, CLASSES)), np.zeros((GROUPS, CLASSES))
        np.add.at(observed, group, seen)
        np.add.at(noise, group, NOISE * expected)
        return group, self.after.fit_counts(observed, noise) @ self.after.features.T.astype(np.float64)

    def pair_of_groups(self, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        """second, third: classes two and three places back."""
        return self.group[0][second] * GROUPS + self.group[1][third]

    def inputs(self, kind: np.ndarray, starts: np.ndarray, near: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own input embeddings, and ln Z(h, g, g') by pair of groups."""
        own = self.after.fit(kind, starts, near, n)
        log_z = np.empty((len(own), GROUPS * GROUPS), dtype=np.float32)
        for i in range(0, len(own), FITTED_TOGETHER):
            some = slice(i, i + FITTED_TOGETHER)
            score = own[some] @ self.after.features.T
            top = score.max(axis=1, keepdims=True)
            log_z[some] = np.log((self.after.reference[kind[some]] * np.exp(score - top)) @ self.lifted) + top
        return own, log_z

    def added(self, own_in: np.ndarray, own_out: np.ndarray, log_z: np.ndarray, around: np.ndarray) -> np.ndarray:
        """What their own embeddings add to ln P of words and of those after them. log_z: less the class's; all by occurrence."""
        near, dot = around % CLASSES**2, lambda a, b: np.einsum("ij,ij->i", a, b)
        step = dot(own_out, self.before.features[near // CLASSES]).astype(np.float64)
        return step + dot(own_in, self.after.features[near % CLASSES]) - log_z

    def add_outputs(self, z: np.ndarray, own: np.ndarray, kind: np.ndarray, c: np.ndarray) -> None:
        """Adds the words to Z(k, j); z has a row for each shared class."""
        order = np.argsort(kind, kind="stable")
        for i in range(0, len(own), FITTED_TOGETHER):
            some = order[i : i + FITTED_TOGETHER]
            weight = np.exp(own[some] @ self.before.features.T)
            weight *= (c[some, None] + 1).astype(np.float32)
            k, first = np.unique(kind[some] - 1 - OWN_CLASSES, return_index=True)
            z[k] += np.add.reduceat(weight, first)


#: Three kinds of rows: counts of pairs of classes (by place, then pair); a head word's neighbours, as side and class (int16) and counts (int64); an occurrence of another word.
SEEN = "pair long, n long, i long, side binary, times binary, word binary, around int"
_SEEN = {"pair": pa.int64(), "n": pa.int64(), "i": pa.int64(), "side": pa.binary(), "times": pa.binary(), "word": pa.binary(), "around": pa.int32()}


def _seen(size: int, **columns) -> pa.RecordBatch:
    whole = lambda x, t: x if isinstance(x, pa.Array) else pa.array(x, t)
    return pa.RecordBatch.from_arrays([whole(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in _SEEN.items()], names=list(_SEEN))


def _context_counter(vocabulary):
    """Counts of pairs of classes and of the head's neighbours, and each occurrence of other words."""

    def count(batches):
        voc = vocabulary.value
        found = np.zeros((3, CLASSES * CLASSES), dtype=np.int64)
        known, times, fresh, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for x in voc.encode(text_bytes(batch.column("text"))):
                for places in range(3):
                    found[places] += np.bincount(x.before(places + 1) * CLASSES + x.kind, minlength=CLASSES * CLASSES)
                before, after = x.before(1), x.after()
                shared = np.flatnonzero(x.at >= OWN_CLASSES)
                base = x.at[shared] * 2 * CLASSES
                fresh += [base + before[shared], base + CLASSES + after[shared]]
                held += 2 * len(base)
                if held > NEIGHBOURS_TOGETHER:
                    known, times = _with_more(known, times, fresh)
                    if len(known) > NEIGHBOURS_TOGETHER // 2:
                        yield from _head_rows(known, times)
                        known, times = known[:0], times[:0]
                    fresh, held = [], len(known)
                if len(x.others):
                    yield _seen(len(x.others), word=x.others, around=before[x.missing] * CLASSES + after[x.missing])
        yield from _head_rows(*_with_more(known, times, fresh))
        found = found.ravel()
        at = np.flatnonzero(found)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield _seen(len(part), pair=part, n=found[part])

    return count


def _with_more(known: np.ndarray, times: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each has been met: ``times`` (changed in place) if known before, and once for each fresh one, of which none stay."""
    if not fresh:
        return known, times
    keys = np.concatenate(fresh)
    fresh.clear()
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    n, keys = np.diff(first, append=len(keys)), keys[first]
    at = np.searchsorted(known, keys)
    met = at < len(known)
    met[met] = known[at[met]] == keys[met]
    times[at[met]] += n[met]
    at, keys, n = at[~met], keys[~met], n[~met]
    return np.insert(known, at, keys), np.insert(times, at, n)


def _head_rows(keys: np.ndarray, n: np.ndarray):
    """keys: in order. One row for each word of the head."""
    if not len(keys):
        return
    i, first = np.unique(keys // (2 * CLASSES), return_index=True)
    side, first = (keys % (2 * CLASSES)).astype(np.int16), np.append(first, len(keys))
    for k in range(0, len(i), 10_000):
        bounds = first[k : k + 10_001]
        yield _seen(len(bounds) - 1, i=i[k : k + 10_000], side=_stretches(side, bounds), times=_stretches(n, bounds))


def _stretches(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of the values from each bound up to the next."""
    offsets = ((bounds - bounds[0]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values[bounds[0] : bounds[-1]])])


def _lists(column) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins in the flat values, and these."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return (offsets[:-1] - offsets[0]).astype(np.int64), column.flatten()


FITTED = "i long, own_in binary, own_out binary, log_z binary, z binary"
_FITTED = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _z_row(z: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, z.tobytes()), _FITTED)], names=[x.split()[0] for x in FITTED.split(", ")])


def _head_fitter(vocabulary, model):
    """Rows i, near (list of side, times): embeddings of the head's words, and their part of Z."""

    def fit(batches):
        voc, m = vocabulary.value, model.value
        z = np.zeros((SUFFIX_CLASSES, CLASSES))
        for batch in batches:
            i = batch.column("i").to_numpy()
            if not len(i):
                continue
            starts, flat = _lists(batch.column("near"))
            owner = np.repeat(np.arange(len(i)), np.diff(np.append(starts, len(flat))))
            n = np.zeros((len(i), 2 * CLASSES), dtype=np.int64)
            for word, side, times in zip(owner.tolist(), _objects(flat.field("side")), _objects(flat.field("times"))):
                n[word, np.frombuffer(side, np.int16)] += np.frombuffer(times, np.int64)
            owner, side = np.nonzero(n)
            n = n[owner, side]
            sides = []
            for which in (side < CLASSES, side >= CLASSES):  # each token has a neighbour on either side
                sides.append((np.searchsorted(owner[which], np.arange(len(i))), side[which] % CLASSES, n[which]))
            kind = voc.classes[i]
            out = m.before.fit(kind, *sides[0])
            own, log_z = m.inputs(kind, *sides[1])
            m.add_outputs(z, out, kind, voc.counts[i])
            rows = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (own, out, log_z - m.class_z[kind])]
            yield pa.RecordBatch.from_arrays([pa.array(i), *rows, pa.nulls(len(i), pa.binary())], names=[x.split()[0] for x in FITTED.split(", ")])
        yield _z_row(z)

    return fit


def _rest_normaliser(model):
    """Rows word, around (list): the part of Z of words beyond the head."""

    def add(batches):
        m = model.value
        z = np.zeros((SUFFIX_CLASSES, CLASSES))
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, around = _lists(batch.column("around"))
            around = around.to_numpy()
            kind = suffix_classes(batch.column("word"))
            out = m.before.fit(kind, starts, around // CLASSES, np.ones(len(around)))
            m.add_outputs(z, out, kind, np.diff(np.append(starts, len(around))))
        yield _z_row(z)

    return add


#: A frequent word beyond the head: how often it was learned, and what _FITTED says of it.
OFTEN = "word binary, c long, own_in binary, own_out binary, log_z binary, z binary"


def _most_frequent(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > GATHERED).select("word")


def _beside(occurrences: DataFrame, often: DataFrame) -> DataFrame:
    """(word, near): of each frequent word the classes before it, those after it from CLASSES on, and their counts."""
    near = F.pmod("around", F.lit(CLASSES**2))
    side = F.explode(F.array((near / CLASSES).cast("int"), F.lit(CLASSES) + F.pmod(near, F.lit(CLASSES))))
    counts = occurrences.join(often, "word").select("word", side.alias("side")).groupBy("word", "side").agg(F.count("*").alias("n"))
    return counts.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("side", "n"))).alias("near"))


def _often_fitter(model):
    """Rows word, near (list of side, n): embeddings of frequent words beyond the head, and their part of Z."""

    def fit(batches):
        m = model.value
        z = np.zeros((SUFFIX_CLASSES, CLASSES))
        names = [x.split()[0] for x in OFTEN.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, flat = _lists(batch.column("near"))
            side, n = flat.field("side").to_numpy(), flat.field("n").to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.append(starts, len(side))))
            sides = []
            for which in (side < CLASSES, side >= CLASSES):
                sides.append((np.searchsorted(owner[which], np.arange(batch.num_rows)), side[which] % CLASSES, n[which]))
            kind = suffix_classes(batch.column("word"))
            c = np.add.reduceat(sides[0][2], sides[0][0])
            out = m.before.fit(kind, *sides[0])
            own, log_z = m.inputs(kind, *sides[1])
            m.add_outputs(z, out, kind, c)
            rows = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (own, out, log_z - m.class_z[kind])]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c, pa.int64()), *rows, pa.nulls(len(c), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.binary(), pa.int64(), *[pa.binary()] * 3)), pa.array([z.tobytes()], pa.binary())], names=names)

    return fit


def _add_z(batches):
    z = np.zeros((SUFFIX_CLASSES, CLASSES))
    for batch in batches:
        for data in batch.column("z").to_pylist():
            z += np.frombuffer(data).reshape(z.shape)
    yield _z_row(z)


class Own:
    """The head's own embeddings (zero for words with a class of their own), and log10 Z(k, j).

    log_z: ln Z(h, g, g') less that of the word's class.
    """

    def __init__(self, words: int, fitted: pa.Table, z: np.ndarray):
        self.inputs, self.outputs = (np.zeros((words, DIMENSION), dtype=np.float32) for _ in range(2))
        self.log_z = np.zeros((words, GROUPS * GROUPS), dtype=np.float32)
        if fitted.num_rows:
            i = fitted.column("i").to_numpy()
            for name, where in (("own_in", self.inputs), ("own_out", self.outputs), ("log_z", self.log_z)):
                where[i] = np.frombuffer(b"".join(fitted.column(name).to_pylist()), np.float32).reshape(len(i), -1)
        self.log_total = np.zeros((CLASSES, CLASSES), dtype=np.float32)
        self.log_total[1 + OWN_CLASSES :] = np.log10(1 + z)  # one unseen word


CONTRIBUTED = "row long, rest_known long, rest_logs double, rest_score double"


def _rest_scorer(model):
    """Rows word, seen (list of row, around, held_out): what each occurrence adds to its text's score."""

    def score(batches):
        m = model.value
        for batch in batches:
            starts, flat = _lists(batch.column("seen"))
            row, around = flat.field("row").to_numpy(), flat.field("around").to_numpy()
            groups = around // CLASSES**2
            learned = ~flat.field("held_out").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.append(starts, len(row))))
            c = np.bincount(owner[learned], minlength=batch.num_rows)
            met = np.flatnonzero(c)
            if not len(met):
                continue
            place = np.cumsum(c > 0) - 1
            kind = suffix_classes(batch.column("word"))[met]
            first = np.concatenate([[0], np.cumsum(c[met])[:-1]])
            near, one = around[learned] % CLASSES**2, np.ones(int(c.sum()))
            out = m.before.fit(kind, first, near // CLASSES, one)
            own, log_z = m.inputs(kind, first, near % CLASSES, one)
            known = c[owner] > 0
            row, around, groups, owner = row[known], around[known], groups[known], owner[known]
            p = place[owner]
            yield _contributed(row, c[owner], m.added(own[p], out[p], (log_z - m.class_z[kind])[p, groups], around))

    return score


def _contributed(row: np.ndarray, c: np.ndarray, step: np.ndarray) -> pa.RecordBatch:
    logs = np.log10(c + 1)
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.ones(len(row), np.int64)), pa.array(logs), pa.array(logs + step / math.log(10))], names=[x.split()[0] for x in CONTRIBUTED.split(", ")])


def _often_scorer(model):
    """Rows row, around, c, own_in, own_out, log_z: occurrences of frequent words beyond the head with these words' parameters."""

    def score(batches):
        m = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, out, log_z = (_floats(batch.column(k)) for k in ("own_in", "own_out", "log_z"))
            around = batch.column("around").to_numpy()
            yield _contributed(batch.column("row").to_numpy(), batch.column("c").to_numpy(), m.added(own, out, log_z[np.arange(len(around)), around // CLASSES**2], around))

    return score


HEAD = "doc_id long, held_out boolean, n_tokens long, known long, logs double, within double, classes double, rest array<binary>, around array<int>"


def _scorer(vocabulary, model, own):
    """Rest: the words beyond the head of each text; around: the groups, and the classes before and after, where they stand."""

    def score(batches):
        voc, m, o = vocabulary.value, model.value, own.value
        log_count = np.log10(voc.counts + 1)
        end_log, end_known = math.log10(voc.end_count + 1), int(voc.end_count > 0)
        dot = lambda a, b: np.einsum("ij,ij->i", a, b).astype(np.float64)
        for batch in batches:
            parts = []
            for x in voc.encode(text_bytes(batch.column("text"))):
                before, groups = x.before(1), m.pair_of_groups(x.before(2), x.before(3))
                head, shared = np.flatnonzero(x.at >= 0), np.flatnonzero(x.at >= OWN_CLASSES)
                i, last = x.at[shared], x.earlier(x.at, 1, -1)
                given = np.flatnonzero(last >= OWN_CLASSES)  # tokens after a word with an input embedding of its own
                logs = log_count[x.at[head]]
                step = m.log_p[before, x.kind].astype(np.float64) + (m.shift[groups, x.kind] - m.class_z[before, groups]) / math.log(10)
                step[shared] += dot(o.outputs[i], m.before.features[before[shared]]) / math.log(10)
                adjusted = dot(o.inputs[last[given]], m.after.features[x.kind[given]]) - o.log_z[last[given], groups[given]]
                step[given] += adjusted / math.log(10)
                # words that share a class: their counts' logarithms, less the class's
                within = x.by_text(log_count[i], shared) - x.by_text(o.log_total[x.kind, before])
                counted = np.cumsum(np.bincount(np.searchsorted(x.starts, x.missing, "right") - 1, minlength=len(x.sizes)))
                offsets = pa.array(np.concatenate([[0], counted]), pa.int32())
                around = (np.append(groups[1:], 0) * CLASSES + before) * CLASSES + x.after()
                parts.append(
                    [
                        pa.array(x.sizes, pa.int64()),
                        pa.array(x.by_text(np.ones(len(head)), head).astype(np.int64) + end_known),
                        pa.array(x.by_text(logs, head) + end_log),
                        pa.array(within),
                        pa.array(x.by_text(step)),
                        pa.ListArray.from_arrays(offsets, x.others),
                        pa.ListArray.from_arrays(offsets, pa.array(around[x.missing], pa.int32())),
                    ]
                )
            if parts:
                columns = [pa.concat_arrays(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], names=[x.split()[0] for x in HEAD.split(", ")])

    return score


class Trained(NamedTuple):
    vocabulary: Vocabulary
    model: Model
    own: Own


def learn(texts: DataFrame, work: Workspace) -> Trained:
    """The model of a table with a column ``text``."""
    return _learn(texts, work)[0]


def _learn(texts: DataFrame, work: Workspace) -> tuple[Trained, DataFrame]:
    """The model, and the saved table of words beyond the head that were learned more than ``GATHERED`` times."""
    spark = texts.sparkSession
    counts = work.save(map_arrow(texts, _count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    voc, beyond = learn_vocabulary(counts)
    often = work.save(beyond.where(F.col("c") > GATHERED).select("word"))
    vocabulary = spark.sparkContext.broadcast(voc)
    seen = work.save(map_arrow(texts, _context_counter(vocabulary), SEEN))
    work.drop(counts)
    found = seen.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(3 * CLASSES * CLASSES)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    model = Model(*pairs.reshape(3, CLASSES, CLASSES))
    sent = spark.sparkContext.broadcast(model)

    near = seen.where("i is not null").groupBy("i").agg(F.collect_list(F.struct("side", "times")).alias("near"))
    fitted = work.save(map_arrow(near, _head_fitter(vocabulary, sent), FITTED))
    others = seen.where("word is not null").select("word", "around")
    parts = fitted.select("z")
    if not often.isEmpty():
        parts = parts.union(map_arrow(_beside(others, often), _often_fitter(sent), OFTEN).select("z"))
        others = others.join(often, "word", "left_anti")
    rest = work.save(map_arrow(others.groupBy("word").agg(F.collect_list("around").alias("around")), _rest_normaliser(sent), FITTED))
    parts = rest.select("z").union(parts).where("z is not null")
    z = np.zeros((SUFFIX_CLASSES, CLASSES))
    for r in map_arrow(parts.repartition(8), _add_z, FITTED).select("z").collect():  # however many tasks there were
        z += np.frombuffer(r["z"]).reshape(z.shape)
    own = Own(len(voc.words), fitted.where("i is not null").drop("z").toArrow(), z)
    for table in (seen, fitted, rest):
        work.drop(table)
    for broadcast in (vocabulary, sent):
        broadcast.destroy()
    return Trained(voc, model, own), often


def score_texts(docs: DataFrame, folds: int = 7, left_out: int = 2, work: Workspace | None = None) -> DataFrame:
    """One row per document; those of fold ``left_out`` are not learned from.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (the
    model's log10 probability of the whole text).
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "lbl", LONG_ROWS)
    held_out = F.coalesce(crc_mod("doc_id", folds) == left_out, F.lit(True))
    rows = id_and_text(docs, held_out.alias("held_out"))
    learned = rows.where(~F.col("held_out")).select("text")
    trained, often = _learn(learned, work)
    voc = trained.vocabulary
    vocabulary, model, own = (spark.sparkContext.broadcast(x) for x in trained)

    head = work.save(map_arrow(rows, _scorer(vocabulary, model, own), HEAD).withColumn("row", F.monotonically_increasing_id()))
    found = head.select("row", "held_out", F.explode(F.arrays_zip("rest", "around")).alias("x")).select("row", "held_out", F.col("x.rest").alias("word"), F.col("x.around").alias("around"))
    often = work.save(often.union(_most_frequent(head.where("held_out").select(F.explode("rest").alias("word")))).distinct())
    few, more = found, None
    if not often.isEmpty():
        fitted = work.save(map_arrow(_beside(found.where(~F.col("held_out")), often), _often_fitter(model), OFTEN)).where("word is not null").drop("z")
        more = map_arrow(found.drop("held_out").join(fitted, "word").drop("word"), _often_scorer(model), CONTRIBUTED)
        few = found.join(often, "word", "left_anti")
    each = few.groupBy("word").agg(F.collect_list(F.struct("row", "around", "held_out")).alias("seen"))
    rest = map_arrow(each, _rest_scorer(model), CONTRIBUTED)
    rest = rest if more is None else rest.union(more)
    rest = work.save(rest.groupBy("row").agg(*(F.sum(x).alias(x) for x in ("rest_known", "rest_logs", "rest_score"))))
    for broadcast in (vocabulary, model, own):
        broadcast.destroy()
    c, zero = F.col, lambda x: F.coalesce(F.col(x), F.lit(0))
    return head.drop("rest", "around").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (c("known") + zero("rest_known")).alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (c("logs") + zero("rest_logs") - c("n_tokens") * math.log10(voc.total + voc.distinct + 1)).alias("base_score"),
        (c("classes") + c("within") + zero("rest_score")).alias("score"),
    )
