"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks."""

from __future__ import annotations

import ctypes
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The kernel compares subsequences of three characters that span at most SPAN, each weighing DECAY to the power of its span.
SPAN, DECAY = 5, 0.7
#: Characters fall into 64 classes; a subsequence has a code of three times 6 bits.
CODES = 1 << 18
#: Landmarks: words of toxic texts only; the most frequent words of other texts, and those most like each of the first.
INSULTS, OTHERS, LIKE = 128, 64, 4
#: Labelled texts that the model is fitted on, at most so many of each class, and as many more that its scores are calibrated on: those of least hash.
SAMPLE = 1200
#: So many times as many texts without insults.
CLEAN = 3
ROUNDS = 5
THRESHOLD = 0.7
#: The strength of regularisation, and how many words of each text without insults are kept as counterexamples in a round.
RIDGE, HARD = 2e-6, 6
#: The share of toxic texts that a word must stand in to be an example by itself; three texts at least.
COMMON = 0.004
#: Clean texts whose words are compared with the landmarks.
CONFUSABLE = 300
SEED = 3
#: Rows, texts and words handled at once while fitting.
PART = 1024


def _classes() -> np.ndarray:
    """The class of each UTF-8 byte: 0 ends a word, 64 is passed over."""
    out = np.full(256, 64, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = np.arange(27, 37)
    out[0x80:0xC0] = 37 + np.arange(64) % 27
    return out


CLASSES = _classes()
STEPS = [(a, b, DECAY ** (b + 1)) for a, b in itertools.combinations(range(1, SPAN), 2)]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of the characters of all texts, each word followed by a 0; where words begin; the text of each word).

    Case and punctuation are passed over, and single characters that stand in a row are one word: so are those of an insult that is spaced out.
    Each text begins with an empty word.
    """
    raw = [(t or "").lower().encode() for t in texts]
    of = np.repeat(np.arange(len(raw)), [len(x) + 2 for x in raw])
    z = CLASSES[np.frombuffer(b"".join(b"  " + x for x in raw), np.uint8)]
    keep = z < 64
    z, of = z[keep], of[keep]
    ends = np.flatnonzero(z == 0)
    length = np.diff(np.r_[ends, len(z)]) - 1  # of the word after each end
    single = (length == 1) & (np.r_[0, length[:-1]] == 1) & (of[ends] == np.r_[-1, of[ends][:-1]])
    keep = np.ones(len(z), bool)
    keep[ends[single]] = False
    z, of = z[keep], of[keep]
    starts = np.flatnonzero(z == 0)
    return z, starts.astype(np.int32), of[starts].astype(np.int32)


def subsequences(z: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of a subsequence: positions where it lies within a word, its codes there, and its weight."""
    n = len(z)
    length = np.diff(np.r_[starts, n])
    left = np.repeat(starts + length, length) - np.arange(n)  # characters up to the end of the word
    left[starts] = 0
    wide = z.astype(np.int32)
    for a, b, weight in STEPS:
        at = np.flatnonzero(left > b)
        yield at, wide[at] << 12 | wide[at + a] << 6 | wide[at + b], weight


def norms(length: np.ndarray) -> np.ndarray:
    """The length, in the kernel's space, of a word of so many characters whose subsequences all differ; that of the shortest word with any, at least."""
    square = sum(weight**2 * np.maximum(0, length - b) for _, b, weight in STEPS)
    return np.sqrt(np.maximum(square, min(weight**2 for *_, weight in STEPS)))


def word_sums(z: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word, the sum over its subsequences of weight times table[code], over the word's norm."""
    total = np.zeros(len(z), np.float32)
    for at, codes, weight in subsequences(z, starts):
        total[at] += np.float32(weight) * table[codes]
    return np.add.reduceat(total, starts) / norms(np.diff(np.r_[starts, len(z)]) - 1) if len(starts) else np.empty(0)


def kernel(z: np.ndarray, starts: np.ndarray, landmarks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The kernel of each word, over its norm, with each landmark; rows[code]: the row of a subsequence in `landmarks`, -1 if none has it."""
    out = np.zeros((len(starts), landmarks.shape[1]), np.float32)
    word = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(z)]))
    for at, codes, weight in subsequences(z, starts):
        hit = np.flatnonzero(rows[codes] >= 0)
        for part in np.array_split(hit, max(1, len(hit) // PART)):
            if len(part):
                of = word[at[part]]
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                out[of[first]] += weight * np.add.reduceat(landmarks[rows[codes[part]]], first)
    out /= norms(np.diff(np.r_[starts, len(z)]) - 1)[:, None].astype(np.float32)
    return out


def features_of(z: np.ndarray, starts: np.ndarray, landmarks: np.ndarray, rows: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The kernel times root, PART words at a time."""
    out = np.empty((len(starts), root.shape[1]), np.float32)
    for at, some in enumerate(parts_of(z, starts)):
        np.matmul(kernel(*some, landmarks, rows), root, out=out[at * PART : at * PART + PART])
    return out


def _weights(words: list[str], more: list[bytes] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """(subsequences by words, rows): each word's weight of each subsequence that any of them has, of length 1 a word. more: words given by their classes."""
    z, starts, of = symbols(words)
    starts = np.r_[starts, len(z) + np.cumsum([0, *map(len, more)])[:-1]].astype(np.int64)
    z, of = np.r_[z, np.frombuffer(b"".join(more), np.uint8)], np.r_[of, len(words) + np.arange(len(more))]
    word = of[np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(z)]))]
    found = list(subsequences(z, starts))
    rows = np.full(CODES, -1)
    codes = np.unique(np.concatenate([c for _, c, _ in found]))
    rows[codes] = np.arange(len(codes))
    out = np.zeros((len(codes), len(words) + len(more)))
    for at, c, weight in found:
        np.add.at(out, (rows[c], word[at]), weight)
    return out / np.maximum(np.linalg.norm(out, axis=0), 1e-9), rows


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights, bias last, of a linear machine with squared hinge loss, by Newton steps. Rows are taken a few thousand at a time."""
    parts = [slice(i, i + PART) for i in range(0, len(x), PART)]
    m = x.shape[1]
    w = np.zeros(m + 1)
    ridge = RIDGE * np.r_[np.ones(m), 0.01]
    for _ in range(30):
        curve, pull = np.diag(ridge), np.zeros(m + 1)
        for p in parts:
            active = y[p] * (x[p] @ w[:-1] + w[-1]) < 1
            xa = np.c_[x[p][active], np.ones(active.sum())]
            weighted = xa * weight[p][active, None]
            curve = curve + weighted.T @ xa
            pull += weighted.T @ y[p][active]
        step = np.linalg.solve(curve, pull) - w
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """One weight for each subsequence, a bias, and the calibration of a text's largest word score to a probability."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, shift: float):
        self.table, self.bias, self.slope, self.shift = table.astype(np.float32), bias, slope, shift

    def decide(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([self._decide(texts[i : i + 128]) for i in range(0, len(texts), 128)] or [np.empty(0)])

    def _decide(self, texts: list[str | None]) -> np.ndarray:
        """The largest decision value of any word of each text, within the margin and as much again; each text has the empty word."""
        z, starts, of = symbols(texts)
        sums = word_sums(z, starts, self.table)
        if not len(texts):
            return np.empty(0)
        return np.clip(np.maximum.reduceat(sums, np.flatnonzero(np.r_[True, of[1:] != of[:-1]])).astype(float) + self.bias, -2, 2)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decide(texts) + self.shift, -500, 500)))


def _words(text: str) -> set[str]:
    return {w for w in ("".join(filter(str.isalnum, x)) for x in text.lower().split()) if len(w) > 3}


def words_in(z: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The classes of each word, the 0 before it among them."""
    held = z.tobytes()
    return [held[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(z)])]


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """z and starts of words that words_in gave."""
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)], dtype=np.int64)[:-1]


def parts_of(z: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """z and starts of PART words at a time."""
    ends = np.r_[starts[1:], len(z)]
    for at in range(0, len(starts), PART):
        some = slice(at, at + PART)
        yield z[starts[some][0] : ends[some][-1]], starts[some] - starts[some][0]


def indexed(groups: list[list[str]]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """(the distinct words of all texts, for each group the numbers of its texts' words and where each text begins)."""
    number: dict[bytes, int] = {}
    out = []
    for texts in groups:
        ids, begin, n = [], [], 0
        for at in range(0, len(texts), 256):
            z, starts, of = symbols(texts[at : at + 256])
            ids.append(np.array([number.setdefault(x, len(number)) for x in words_in(z, starts)], np.int32))
            begin.append(n + np.flatnonzero(np.r_[True, of[1:] != of[:-1]]))
            n += len(starts)
        out.append((np.concatenate(ids or [np.empty(0, np.int32)]), np.concatenate(begin or [np.empty(0, np.int64)])))
    return list(number), out


def landmark_words(toxic: list[str], clean: list[str]) -> tuple[dict[str, int], list[str]]:
    """Words of toxic texts only, with the number of groups of texts that they stand in, those of most groups; and the words in most clean texts.

    A group's texts agree in the least hash of their five-word shingles, as near copies mostly do; so copies of one text make no word common.
    """
    good = Counter(itertools.chain.from_iterable(map(_words, set(clean))))
    bad: dict[str, set[int]] = {}
    for text in set(toxic):
        every = text.lower().split()
        group = min(zlib.crc32(" ".join(every[i : i + 5]).encode()) for i in range(max(1, len(every) - 4)))
        for w in _words(text):
            if w not in good:
                bad.setdefault(w, set()).add(group)
    only = sorted((-len(g), w) for w, g in bad.items())[:INSULTS]
    return {w: -n for n, w in only}, [w for _, w in sorted((-n, w) for w, n in good.items())[:OTHERS]]


def variants(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with one character inserted, at two places, and with one between any two."""
    more = rng.integers(1, 27, len(word) + 2).astype(np.uint8).tobytes()
    places = rng.integers(2, max(3, len(word)), 2)
    spaced = b"".join(bytes([c, m]) for c, m in zip(word[1:], more))[:-1]
    return [word[:p] + more[i : i + 1] + word[p:] for i, p in enumerate(places.tolist())] + [word[:1] + spaced]


def fit(toxic: list[str], clean: list[str], more: list[str], labels: np.ndarray) -> Model:
    """Fit on texts with and without insults; calibrate on `more` and their labels.

    A text's label says that one of its words is an insult, or that none is. So the machine is fitted in rounds: each toxic text gives the word that scores highest so far, each other
    text its HARD highest, which stay counterexamples for all later rounds. Words of toxic texts only that stand in COMMON of them or more, and variants of them with characters inserted, are examples in each round.
    """
    only, others = landmark_words(toxic, clean)
    words = [*only, *others]
    rest = len(labels) - labels.sum()
    if not only or not others:
        return Model(np.zeros(CODES), 0.0, 1.0, float(np.log((labels.sum() + 1) / (rest + 1))))
    z, starts, _ = symbols(sorted(set().union(*map(_words, clean[:CONFUSABLE]))))
    alike = kernel(z, starts, *_weights(list(only)))
    like = np.unique([np.argsort(-alike[:, j])[:LIKE] for j in range(alike.shape[1])])
    candidates = words_in(z, starts)
    near = {candidates[i] for i in like}
    del alike, candidates
    marks, rows = _weights(words, sorted(near))
    value, vector = np.linalg.eigh(marks.T @ marks)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T  # of the landmarks' kernel matrix, inverted
    used = rows >= 0

    def spread(alpha: np.ndarray) -> np.ndarray:
        table = np.zeros(CODES)
        table[used] = marks[rows[used]] @ alpha
        return table

    weights = spread(np.r_[[n / len(toxic) for n in only.values()], -np.ones(len(others) + len(near)) / len(others)])
    vocabulary, (bad, good) = indexed([toxic, clean])
    z, starts = joined(vocabulary)
    of_clean = np.zeros(len(vocabulary), bool)
    of_clean[good[0]] = True

    def picked(ids: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
        """The n words that score highest in each text, by their numbers."""
        sums = np.concatenate([word_sums(*some, weights.astype(np.float32)) for some in parts_of(z, starts)])[ids]
        text = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(ids)]))
        order = np.lexsort((-sums, text))
        return ids[order[np.arange(len(ids)) - begin[text] < n]]

    rng = np.random.default_rng(SEED)
    known = [x for x in words_in(*symbols([w for w, n in only.items() if n >= max(3, COMMON * len(toxic))])[:2]) if len(x) > 1]
    examples = Counter(known) + Counter(v for x in known for v in variants(x, rng))
    each = 5 / max(1, len(examples))
    number = {x: i for i, x in enumerate(vocabulary)}
    examples = {x: n for x, n in examples.items() if not (x in number and of_clean[number[x]])}
    del number
    hard = np.zeros(len(vocabulary), bool)
    hard[picked(*good, HARD)] = True
    for _ in range(ROUNDS):
        top = np.bincount(picked(*bad, 1), minlength=len(vocabulary)) * ~of_clean
        positive = {vocabulary[i]: int(top[i]) / len(toxic) for i in np.flatnonzero(top)}
        for x, n in examples.items():
            positive[x] = positive.get(x, 0) + n * each
        keys = [*positive, *sorted(vocabulary[i] for i in np.flatnonzero(hard) if vocabulary[i] not in positive)]
        n_bad, n_good = len(positive), len(keys) - len(positive)
        w = svm(features_of(*joined(keys), marks, rows, root.astype(np.float32)), np.r_[np.ones(n_bad), -np.ones(n_good)], np.r_[[*positive.values()], np.full(n_good, 10 / max(1, n_good))])
        weights = spread(root @ w[:-1])
        hard[picked(*good, HARD)] = True
    model = Model(weights, w[-1], 1.0, 0.0)
    model.slope, model.shift = platt(model.decide(more), labels)
    return model


def platt(f: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from decision values to probabilities, with Platt's targets."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.c_[f / max(np.abs(f).max(), 1e-9), np.ones(len(f))]

    def loss(w: np.ndarray) -> float:
        s = x @ w
        return float((np.logaddexp(0, s) - target * s).sum() + 1e-6 * w @ w)

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        v = np.maximum(p * (1 - p), 1e-12)
        step = np.linalg.solve((x * v[:, None]).T @ x + 2e-6 * np.eye(2), x.T @ (target - p) - 2e-6 * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(max(w[0], 1e-6) / max(np.abs(f).max(), 1e-9)), float(w[1])


def fold(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows of fold 0, calibrated on fold 2; at most `sample` toxic texts and CLEAN times as many others of each fold, those whose ids hash lowest, reach the driver.

    A doc_id with several labels counts as toxic if one says so; null labels and ids don't count. Of a doc_id with several texts, the model learns from the greatest in order of characters. A null text is an
    empty one. Without toxic examples, or others, every text gets the share of toxic ones as its score.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold != 1")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    found: dict[tuple[int, int], list[str]] = {}
    chosen = known.where("false").select("doc_id", "toxic", "fold", F.lit(0).cast("long").alias("h"))
    present = known.join(texts.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi")
    for f, toxic in itertools.product((0, 2), (0, 1)):
        n = sample * (1 if toxic else CLEAN)
        chosen = chosen.unionByName(present.where((F.col("fold") == f) & (F.col("toxic") == toxic)).withColumn("h", F.xxhash64(F.lit("sample"), "doc_id")).orderBy("h", "doc_id").limit(n))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).groupBy("doc_id", "fold", "toxic").agg(F.max("text").alias("text"))
    for r in rows.orderBy("doc_id").toLocalIterator():
        found.setdefault((r.fold, r.toxic), []).append(r.text or "")
    get = lambda f, t: found.get((f, t), [])
    model = fit(get(0, 1), get(0, 0), get(2, 1) + get(2, 0), np.r_[np.ones(len(get(2, 1))), np.zeros(len(get(2, 0)))])
    found.clear()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)  # else the C library keeps what the fit has freed
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) in place of the text: the probability that it is toxic, by its most insulting word. A null text is scored as an empty one, repeated rows each, and an empty table gives an empty one."""
    keep = [c for c in docs.columns if c != text]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(held.value.score(b.column(len(keep)).to_pylist()))], names=[*keep, "score"])

    return docs.select(*keep, text).mapInArrow(run, docs.select(*keep).schema.add("score", "double"))


def op9(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents, as score has them; a null id isn't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below THRESHOLD, by a model trained on the labelled ones among them. Null and empty texts have the score of no insult; repeated rows go or stay together; columns of any names are kept; an empty table gives an empty one."""
    model = train(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    scored = score(docs.select(F.struct(*columns).alias("__row"), F.col("text").alias("__text")), model, "__text")
    return scored.where(F.col("score") < THRESHOLD).select("__row.*")
