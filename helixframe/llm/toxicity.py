"""Toxicity by subword bags: character n-gram vectors averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of itself; a passage's is the mean over its
PASSAGE words, and a document's score the soft maximum over its passages, so a few words count in a long text too.
Vectors and softmax are fitted together, from random starts, on a bounded sample of labelled rows (FIT_ROWS, the lowest
hashes of the document id). Every n-gram of the sample takes part; how far a step moves its vector falls with how much of
the passages it fills. FOLDS fits leave out another fifth of the sample each, which chooses the epoch and is used for
nothing else, and are averaged. Each fit is a task, which reads the sample's texts one after the other and keeps their
numbers in scratch files; the driver gets the fitted numbers only. As the softmax is linear in the mean, each n-gram's
part of a passage's logit is one number, so what is sent to the tasks is one float for each of BUCKETS buckets, whatever the corpus holds. Every
document is scored on its whole text, in one pass without a shuffle; long texts are scored in parts that end between
words, whose soft maxima combine.

Defined cases: null and empty texts, and texts without letters, score as the average passage of the sample. Without
labels of both kinds nothing is learned and all scores are 0. Repeated rows are scored alike; a
document labelled twice counts as toxic if any label says so; null labels are left out; of rows with one id
the fit takes the smallest text. An empty table gives no rows. Other columns are kept unless named as an output of
``score``; ``keep_clean`` keeps all, whatever their names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix

#: Bound on the labelled rows that a fit takes.
FIT_ROWS = 5000
BUCKETS = 1 << 19
DIMENSIONS = 2
SIZES = (3, 4, 5)
#: Words of a passage; means over passages are small, so both fit and score multiply them by GAIN.
PASSAGE, GAIN = 32, 32.0
#: The soft maximum of n equal passages is log(n) / SHARP more than one of them, so a text's length alone says little.
SHARP = 4.0
#: Fits that are averaged, epochs without gain that end one, and how many texts' worth of passages damp an n-gram's steps.
FOLDS, PATIENCE, DAMPING = 5, 16, 2000.0
CHUNK_CHARS = 1 << 20
#: Numbers of a sample that are taken into memory at once.
BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Bag:
    """Words of some texts: occurrences as (text, word), and each word's buckets as flat lists."""

    text_of: np.ndarray
    word_of: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    keys: np.ndarray


_letters = np.zeros(0, dtype=bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.array([chr(i).isalpha() for i in range(1 << 16)] + [True])
    return _letters[np.minimum(points, 1 << 16)]


def bag(texts: list[str]) -> Bag:
    points = np.frombuffer("\n".join([*(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter(points)
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(letter) and letter[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    breaks = np.cumsum([len(t.lower()) + 1 for t in texts])
    text_of = np.searchsorted(breaks, begin, side="right")
    if not len(begin):
        none = np.zeros(0, dtype=np.int64)
        return Bag(none, none, none, none, none.astype(np.uint64))
    whole = np.zeros(len(begin), dtype=np.uint64)
    size = end - begin
    order = np.argsort(-size, kind="stable")
    left, at = order, 0
    while len(left):  # all words' next letter at once, longest words last
        whole[left] = whole[left] * _BASE + points[begin[left] + at].astype(np.uint64) + np.uint64(1)
        at += 1
        left = left[: int(np.searchsorted(-size[left], -at, side="left"))]
    keys, first, word_of = np.unique(mix(whole), return_index=True, return_inverse=True)
    b, n = begin[first], size[first]
    framed = np.zeros(int((n + 2).sum()), dtype=np.uint64)  # <word> of each distinct word
    offset = np.concatenate(([0], np.cumsum(n + 2)))
    where = np.repeat(offset[:-1] + 1 - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    framed[where] = points[np.repeat(b - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))]
    framed[offset[:-1]], framed[offset[1:] - 1] = 60, 62
    word = np.repeat(np.arange(len(n)), n + 2)
    owners, grams = [np.arange(len(n))], [keys]
    running = np.zeros(len(framed), dtype=np.uint64)
    for k in range(1, max(SIZES) + 1):
        running = running[: len(framed) - k + 1] * _BASE + framed[k - 1 :] + np.uint64(1)
        if k in SIZES:
            inside = np.flatnonzero(word[: len(running)] == word[k - 1 :]) if len(running) else np.zeros(0, dtype=np.int64)
            owners.append(word[inside])
            grams.append(mix(running[inside] + np.uint64(k << 56)))
        if not len(running):
            break
    owner = np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    flat = (np.concatenate(grams)[by] % np.uint64(BUCKETS)).astype(np.int64)
    return Bag(text_of, word_of, flat, np.searchsorted(owner[by], np.arange(len(n))), keys)


def in_parts(text: str) -> list[str]:
    """The text in parts of about CHUNK_CHARS that end at a space."""
    parts, at = [], 0
    while len(text) - at > CHUNK_CHARS and (space := text.find(" ", at + CHUNK_CHARS)) >= 0:
        parts.append(text[at:space])
        at = space
    return [*parts, text[at:]]


def chunks(texts: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, whole texts) of about CHUNK_CHARS."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


@dataclass
class Model:
    """Each bucket's part of a passage's toxic logit, against that of the average word (0 for what the sample does not
    have), and the bias, which is the average passage's logit; no parts where nothing could be learned."""

    parts: np.ndarray | None
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.parts is None:
            return out
        top, total = np.full(len(texts), -np.inf), np.zeros(len(texts))
        owners, parts = zip(*[(i, p) for i, t in enumerate(texts) for p in in_parts(t)]) if texts else ((), ())
        owner = np.array(owners, dtype=np.int64)
        for at, held in chunks(list(parts)):
            found = bag(held)
            if not len(found.text_of):
                continue
            value = np.add.reduceat(self.parts[found.flat], found.starts) / np.diff(np.append(found.starts, len(found.flat)))
            passage, first = passages(found.text_of)
            words = np.bincount(passage)
            logit = GAIN * np.bincount(passage, weights=value[found.word_of]) / words + self.bias
            of = owner[at + found.text_of[first]]
            before, now = top, top.copy()
            logit *= SHARP
            np.maximum.at(now, of, logit)
            seen = np.isfinite(now)
            total[seen] *= np.exp(before[seen] - now[seen])
            np.add.at(total, of, np.exp(logit - now[of]))
            top = now
        with np.errstate(divide="ignore"):
            logit = np.where(total > 0, (top + np.log(total)) / SHARP, self.bias)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def passages(text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passage of each word occurrence and each passage's first occurrence: a text is cut evenly into passages of at most PASSAGE words."""
    begin = np.flatnonzero(np.concatenate(([True], text_of[1:] != text_of[:-1])))
    size = np.diff(np.append(begin, len(text_of)))
    place = np.arange(len(text_of)) - np.repeat(begin, size)
    number = place * np.repeat(-(-size // PASSAGE), size) // np.repeat(size, size)
    begins = np.concatenate(([True], (text_of[1:] != text_of[:-1]) | (number[1:] != number[:-1])))
    return np.cumsum(begins) - 1, np.flatnonzero(begins)


class Scratch:
    """Numbers of one type in a file of their own, which goes with the object."""

    def __init__(self, dtype: type) -> None:
        self.dtype, self.size, self.file = np.dtype(dtype), 0, tempfile.TemporaryFile()

    def add(self, values: np.ndarray) -> None:
        self.file.write(np.asarray(values, dtype=self.dtype).tobytes())
        self.size += len(values)

    def read(self, begin: int, end: int) -> np.ndarray:
        self.file.seek(int(begin) * self.dtype.itemsize)
        return np.frombuffer(self.file.read(int(end - begin) * self.dtype.itemsize), dtype=self.dtype)


class Sample:
    """A sample's passages as means over words, and words as means over n-grams.

    What grows with the texts' length, a row for each word of a passage and each n-gram of a word, is in scratch files and
    read in blocks; in memory is what there is once for each passage, distinct word or n-gram.
    """

    def __init__(self, texts: Iterable[str]) -> None:
        known, number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # words so far, by key
        none = np.zeros(0, dtype=np.int64)
        here, owner, owners, sizes, lengths, pairs = np.zeros(BUCKETS, dtype=bool), [], [none], [none], [none], [none]
        self.word, self.times, self.flat = Scratch(np.int32), Scratch(np.uint8), Scratch(np.int32)  # times: at most PASSAGE
        self.n_passages = 0

        def parts() -> Iterator[str]:  # cut as scores cuts them
            for i, t in enumerate(texts):
                for p in in_parts(t):
                    owner.append(i)
                    yield p

        for at, held in chunks(parts()):
            b = bag(held)
            if not len(b.keys):
                continue
            place = np.searchsorted(known, b.keys)
            new = place == len(known)
            new[~new] = known[place[~new]] != b.keys[~new]
            numbers = np.zeros(len(b.keys), dtype=np.int64)
            numbers[~new], numbers[new] = number[place[~new]], len(known) + np.arange(int(new.sum()))
            known, number = np.insert(known, place[new], b.keys[new]), np.insert(number, place[new], numbers[new])
            size = np.diff(np.append(b.starts, len(b.flat)))
            sizes.append(size[new])
            flat = b.flat[np.repeat(new, size)]
            here[flat] = True
            self.flat.add(flat)
            passage, begins = passages(b.text_of)
            pair, times = np.unique(passage * len(known) + numbers[b.word_of], return_counts=True)
            self.word.add(pair % len(known))
            self.times.add(times)
            pairs.append(np.bincount(pair // len(known)))
            lengths.append(np.bincount(passage))
            owners.append(np.array(owner)[at + b.text_of[begins]])
            self.n_passages += len(begins)
        self.text, self.n_grams = np.concatenate(owners), np.concatenate(sizes)  # of each passage, of each distinct word
        self.lengths, self.edges = np.concatenate(lengths), np.append(0, np.cumsum(np.concatenate(pairs)))  # of each passage: its words, its first pair
        self.starts = np.cumsum(self.n_grams) - self.n_grams
        self.buckets, self.place = np.flatnonzero(here), np.cumsum(here) - 1

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, word, share of the passage) in blocks, by passage."""
        for i in range(0, self.word.size, BLOCK):
            j = min(i + BLOCK, self.word.size)
            a, z = np.searchsorted(self.edges, i, side="right") - 1, np.searchsorted(self.edges, j)
            passage = np.repeat(np.arange(a, z), np.diff(np.clip(self.edges[a : z + 1], i, j)))
            yield passage, self.word.read(i, j).astype(np.int64), self.times.read(i, j) / self.lengths[passage]

    def grams(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Words in blocks, and their n-grams one word after the other."""
        ends = np.append(self.starts, self.flat.size)
        edges = np.unique(np.append(np.searchsorted(ends, np.arange(0, self.flat.size, BLOCK)), len(self.starts)))
        for a, z in zip(edges[:-1], edges[1:]):
            yield slice(a, z), self.place[self.flat.read(ends[a], ends[z])]

    def forward(self, vectors: np.ndarray) -> np.ndarray:
        """Passages' averaged vectors."""
        words, found = np.zeros((len(vectors), len(self.n_grams))), np.zeros((len(vectors), self.n_passages))
        for w, flat in self.grams():
            for word, v in zip(words, vectors):
                word[w] = np.add.reduceat(v[flat], self.starts[w] - self.starts[w.start]) / self.n_grams[w]
        for passage, of, weight in self.pairs():
            first = passage[0]
            for mean, word in zip(found, words):
                part = np.bincount(passage - first, weights=word[of] * weight)
                mean[first : first + len(part)] += part
        return GAIN * found

    def up(self, words: np.ndarray) -> np.ndarray:
        """The sums of each n-gram's words' numbers."""
        found = np.zeros((len(words), len(self.buckets)))
        for w, flat in self.grams():
            for total, word in zip(found, words):
                total += np.bincount(flat, weights=np.repeat(word[w], self.n_grams[w]), minlength=len(total))
        return found

    def backward(self, error: np.ndarray) -> np.ndarray:
        """The gradient of the n-gram vectors, given that of the passages."""
        words, error = np.zeros((len(error), len(self.n_grams))), GAIN * error
        for passage, of, weight in self.pairs():
            for word, e in zip(words, error):
                word += np.bincount(of, weights=e[passage] * weight, minlength=len(word))
        return self.up(words / self.n_grams)

    def reach(self, fitted: np.ndarray) -> np.ndarray:
        """How far a step moves each n-gram: less the more of the fitted passages it fills, and little if it is in a few texts only."""
        n = len(self.n_grams)
        word, texts, last = np.zeros(n), np.zeros(n), np.full(n, -1)
        for passage, of, weight in self.pairs():
            own = fitted[passage]
            word += np.bincount(of[own], weights=weight[own] ** 2, minlength=n)
            pair = np.unique(self.text[passage[own]] * n + of[own])
            text, of = pair // n, pair % n
            texts += np.bincount(of[last[of] != text], minlength=n)  # a text may go on in the next block
            np.maximum.at(last, of, text)
        filled, held = self.up(np.stack((word / self.n_grams**2, texts)))
        several = held >= 2
        usual = np.median(filled[several] / held[several]) if several.any() else 1.0
        found = 1 / np.sqrt(filled + DAMPING * usual)
        return found / found.max()


def fit_once(sample: Sample, y: np.ndarray, fold: np.ndarray, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """(n-gram parts, bias) at the epoch with the least loss over ``fold``, which is fitted on nothing.

    A step that raises the fitted rows' loss is taken back and halved.
    """
    text, fitted = sample.text, ~fold[sample.text]
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    number = np.cumsum(np.concatenate(([True], text[1:] != text[:-1]))) - 1  # of texts with words
    truth, chosen = y[text[first]], fold[text[first]]
    reach, rng = sample.reach(fitted), np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (DIMENSIONS, len(sample.buckets)))
    soft = rng.normal(0, 1, (2, DIMENSIONS)) / np.sqrt(DIMENSIONS)
    share = np.clip(truth[~chosen].mean(), 0.01, 0.99)
    bias = np.log(np.array([1 - share, share])) - np.array([0, np.log(len(text) / len(first)) / SHARP])  # a text has several passages
    speed, slow = np.zeros_like(vectors), [[np.zeros_like(p), np.zeros_like(p)] for p in (soft, bias)]
    best, kept, saved, last, unit, waited = np.inf, None, None, np.inf, 1.0, 0
    for epoch in range(epochs):
        mean_of = sample.forward(vectors)
        mean = mean_of[:, fitted].mean(axis=1)
        centred = mean_of - mean[:, None]  # the bias takes what all passages have
        z = (soft[1] - soft[0]) @ centred + bias[1] - bias[0]
        top = np.maximum.reduceat(z, first)
        each = np.exp(SHARP * (z - top[number]))
        total = np.add.reduceat(each, first)
        logit = top + np.log(total) / SHARP  # of a text: the soft maximum of its passages
        losses = np.logaddexp(0, np.where(truth == 1, -logit, logit))
        loss = losses[~chosen].mean()
        if loss > last * 1.001:
            vectors, soft, bias = (x.copy() for x in saved)
            speed[:], rate = 0, rate / 2
            for m, _ in slow:
                m[:] = 0
            continue
        last, saved, rate = loss, (vectors.copy(), soft.copy(), bias.copy()), rate * 1.05
        held = losses[chosen].mean() if chosen.any() else loss
        if held < best:
            best, waited = held, 0
            kept = ((soft[1] - soft[0]) @ (vectors - mean[:, None] / GAIN), float(bias[1] - bias[0]))
        elif (waited := waited + 1) == PATIENCE:
            break
        error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - truth) / max((~chosen).sum(), 1)
        error[chosen] = 0
        d = error[number] * each / total[number]
        error = np.stack((-d, d))
        d_mean = soft.T @ error
        d_mean[:, fitted] -= d_mean[:, fitted].mean(axis=1, keepdims=True)
        grads = [sample.backward(d_mean) * reach, error @ centred.T, error.sum(axis=1)]
        if epoch == 0:
            unit = 1 / max(np.sqrt((grads[0] ** 2).mean()), 1e-30)
        speed = 0.9 * speed + unit * grads[0]
        vectors -= rate * speed * reach
        for value, grad, (m, v) in zip((soft, bias), grads[1:], slow):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            value -= 0.02 * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    return kept


def fit_fold(sample: Sample, toxic: list[int], k: int, epochs: int = 48, rate: float = 0.01, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """[(buckets, their parts, bias)] of the fit that leaves out fold ``k``; nothing where it can learn nothing."""
    y, worded = np.array(toxic, dtype=np.int64), np.zeros(len(toxic), dtype=bool)
    worded[sample.text] = True
    fold = np.arange(len(y)) % FOLDS == k
    if len(set(toxic)) < 2 or not worded[~fold].any():
        return []
    return [(sample.buckets, *fit_once(sample, y, fold, epochs, rate, seed + k))]


def averaged(fits: list[tuple[np.ndarray, np.ndarray, float]]) -> Model:
    """The mean of fits; passages' logits are linear, so models average."""
    if not fits:
        return Model(None, 0.0)
    parts = np.zeros(BUCKETS)
    for buckets, part, _ in fits:
        parts[buckets] += part
    return Model(parts / len(fits), float(np.mean([bias for _, _, bias in fits])))


def train(texts: list[str], toxic: list[int], epochs: int = 48, rate: float = 0.01, seed: int = 7) -> Model:
    """The mean of FOLDS fits, each of which leaves out another fifth of the sample to choose its epoch, one after the other."""
    sample = Sample(texts)
    return averaged([f for k in range(FOLDS) for f in fit_fold(sample, toxic, k, epochs, rate, seed)])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no fit may see."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model of at most ``fit_rows`` labelled documents outside the held-out fold."""
    known = labels.where(~held_out(doc_id) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # fit_rows at most, whatever repeats
    each = rows.select(F.explode(F.array(*[F.lit(k) for k in range(FOLDS)])).alias("fold"), "id", "label", "text")
    dealt = each.repartitionByRange(FOLDS, "fold").sortWithinPartitions("fold", "id").select("fold", "label", "text")
    found = dealt.mapInArrow(_fit_folds, "fold int, buckets binary, parts binary, bias double").toArrow().to_pylist()
    return averaged([(np.frombuffer(r["buckets"], dtype=np.int64), np.frombuffer(r["parts"]), r["bias"]) for r in sorted(found, key=lambda r: r["fold"])])


def _fit_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fits of the folds that a task has, each from its rows in order."""
    rows = (r for b in batches for i in range(0, b.num_rows, 100) for r in b.slice(i, 100).to_pylist())
    for k, own in groupby(rows, key=lambda r: r["fold"]):
        toxic: list[int] = []
        sample = Sample(toxic.append(r["label"]) or r["text"] for r in own)
        for buckets, parts, bias in fit_fold(sample, toxic, k):
            yield pa.RecordBatch.from_pydict({"fold": pa.array([k], pa.int32()), "buckets": [buckets.tobytes()], "parts": [parts.tobytes()], "bias": [bias]})


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns with ``score``, which is 0 to 1 and higher for toxic texts, and ``predicted``."""
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one float for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                scores = shared.value.scores([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with the columns of ``docs``: a row travels as one value."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return score(rows, model).where("predicted = 0").select("row.*")
