"""Toxicity by class-conditional Kneser-Ney models of word pairs with a shared backoff.

All counts are continuation counts, so that thousands of copies of one text count once: a word's count is the number
of distinct words before it, a pair's the number of distinct words before the pair. The levels, each of which sums
to one over all words, are

    P_c(w | v) = max(b_c(vw) - D2 q_c(vw), 0) / B_c(v) + back_c(v) P_c(w)
    P_c(w)     = max(a_c(w)  - D1 s_c,    0) / A_c    + back_c    P_shared(w)

``P_shared`` is made of the counts of all documents, labelled or not, and grows with them: it smooths what a class
hardly knows. ``a`` and ``b`` are class counts from which sampling noise has been discounted: a class's count is
moved towards its share of both classes' count by ``NOISE`` standard deviations of that share, and stays at the share
if it is nearer than that. Plain discounts of up to 64 leave the noise of common words and of copies in,
which outweighs a few toxic words in a long text (README has the figures). The standard deviation of a word's share is that
of a sample of whole documents: a word that comes hundreds of times in each of a few documents, such as the articles of a
language that few are in, says little by how the classes share it. ``s`` and ``q`` are the classes' shares of both.

A document's evidence is the difference of its two log-likelihoods divided by its number of words. Isotonic regression
on labelled documents, each scored by a model of the other half of them, makes a probability of it.

Class counts and calibration are learnt from a hash sample of the labelled rows of at most ``SAMPLE_CHARS`` code points
a class, as many for either class (distinct contexts grow less than in proportion, so classes of unlike size can't be
compared); texts longer than a quarter of that don't enter the sample. Nothing but the text is an input of a score.

Defined results: null and empty texts have no words and evidence 0; without labels of both classes every score is
0.25; of several labels of a document the highest counts; a null id counts as held out; repeated rows are scored
alike; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import math
import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, scratch, sliced, small_batches, table, utf8
from .token_files import open_folder

#: Code points of labelled texts, a class, that are learnt from at most. The model has less than 4 bytes for each.
SAMPLE_CHARS = 6_000_000
#: Standard deviations of a class's share that are discounted from its counts.
NOISE = 4.0
#: Code points of text for each part of the shared counts, and word pairs that a task holds at once.
PART_CHARS, HELD_PAIRS = 24_000_000, 1 << 20

_M = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.zeros(256, np.uint8)  # lower-cased, or 0
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(4095, _M)]), dtype=np.uint64)

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, lower-cased in Latin-1) of all texts, and the text of each."""
    data = b"\n".join(texts) + b"\n"
    b = _LETTERS[np.frombuffer(data, np.uint8)]
    upper = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] < 0x9F) & (b[1:] != 0x97)  # A-grave to thorn
    b[1:][upper] += 0x20
    inside = b > 0
    edges = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edges == 1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sizes = np.flatnonzero(edges == -1) - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first, sizes).astype(np.int32)
    h = _mix(np.add.reduceat(b[inside].astype(np.uint64) * _POWERS[place & 4095], first))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(ends, starts, "right")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def triples_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word: the word before the one before it, the one before it, itself, and the number of its text. 0 is no word."""
    w, doc = words_of(texts)
    before = np.concatenate([np.zeros(1, np.uint64), w[:-1]])[: len(w)]
    before[np.diff(doc, prepend=-1) != 0] = 0
    second = np.concatenate([np.zeros(1, np.uint64), before[:-1]])[: len(w)]
    second[before == 0] = 0
    return second, before, w, doc


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(w * _M + _mix(v))


# --- the shared level: distinct contexts of every word of all documents

CONTEXT_BITS = 24
_LOW = np.uint64((1 << CONTEXT_BITS) - 1)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as zstandard-compressed byte planes of their differences."""
    import zstandard

    planes = np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def shared_counts(texts: DataFrame, chars: int) -> DataFrame:
    """w (40 bits of a word's hash), n: cells of 2^24 that its contexts fill, in one or more rows a word.

    A task sends each distinct pair of word and context once, in packed sorted blocks for each part. A word's pairs are
    spread over as many parts as the corpus needs for no word to outgrow one, however frequent it is.
    """
    parts = max(1, math.ceil(chars / PART_CHARS))
    salts = 1 + parts // 8

    def blocks(held: list[np.ndarray]):
        keys = np.unique(np.concatenate(held))
        part = _mix((keys >> np.uint64(CONTEXT_BITS)) * _M + (keys & _LOW) % np.uint64(salts)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        found = [(k, _packed(keys[order[a:b]])) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["part", "keys"])

    def task(batches):
        held, n = [], 0
        for batch in sliced(batches):
            _, v, w, _ = triples_of(utf8(batch.column(0)))
            held.append(np.unique((w & ~_LOW) | (_mix(v) >> np.uint64(64 - CONTEXT_BITS))))
            n += len(held[-1])
            if n > HELD_PAIRS:
                held = [np.unique(np.concatenate(held))]
                n = len(held[0])
                if n > HELD_PAIRS // 2:
                    yield from blocks(held)
                    held, n = [], 0
        if n:
            yield from blocks(held)

    def count(group):
        keys = np.unique(np.concatenate([_unpacked(x) for x in group.column("keys").to_pylist()]))
        w, n = np.unique(keys >> np.uint64(CONTEXT_BITS), return_counts=True)
        return pa.table({"w": pa.array(w.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return small_batches(texts.select("text")).mapInArrow(task, "part int, keys binary").groupBy("part").applyInArrow(count, "w long, n long")


def _contexts(cells: Column) -> Column:
    """Distinct contexts by the cells they fill (linear counting): the same estimator at every size."""
    m = float(1 << CONTEXT_BITS)
    return -m * F.log1p(-F.least(cells, F.lit(m - 1)) / m)


# --- the classes


def toward(n: np.ndarray, expected: np.ndarray, variance: np.ndarray, noise: float = NOISE) -> np.ndarray:
    """Counts moved towards what is expected by ``noise`` standard deviations, and no further."""
    d = n - expected
    return expected + np.sign(d) * np.maximum(np.abs(d) - noise * np.sqrt(variance + 1), 0)


def _discount(n: np.ndarray) -> float:
    """Ney's estimate by the counts of counts."""
    one, two = float((n == 1).sum()), float((n == 2).sum())
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5


@dataclass
class KneserNey:
    """Both classes' probabilities, ordinary and toxic, of words and of words after others."""

    words: np.ndarray  # sorted hashes
    p_word: np.ndarray  # (2, words)
    back: np.ndarray  # (2,): the factor of the shared probability
    contexts: np.ndarray  # sorted hashes
    p_back: np.ndarray  # (2, contexts)
    pairs: np.ndarray  # sorted hashes of context and word
    p_pair: np.ndarray  # (2, pairs)


def estimate(v: np.ndarray, w: np.ndarray, n: np.ndarray, shared: dict | tuple[np.ndarray, np.ndarray], noise: float = NOISE, spread: np.ndarray | None = None) -> KneserNey:
    """The models of the pairs ``v`` ``w``, of which the classes have seen ``n`` (2, pairs) distinct predecessors.

    ``shared``: sorted words and their shared probabilities. ``spread``: of the same words, the variance of a class's
    count against that of contexts drawn one by one; 1 where it isn't given.
    """
    seen = n.sum(axis=0) > 0
    v, w, n = v[seen], w[seen], n[:, seen].astype(np.float32)  # the arrays by pair are the largest
    words, iw = np.unique(w, return_inverse=True)
    known = np.searchsorted(shared[0], words)
    p_shared = shared[1][known]
    m = np.stack([np.bincount(iw, c > 0, len(words)) for c in n])
    both, s = m.sum(axis=0), m.sum(axis=1) / m.sum()
    toxic = toward(m[1], s[1] * both, both * s[0] * s[1] * (1 if spread is None else spread[known]), noise)
    a = np.stack([both - toxic, toxic])
    d = _discount(both) * s[:, None]
    total = a.sum(axis=1)
    back = np.minimum(a, d).sum(axis=1) / total
    p_word = np.maximum(a - d, 0) / total[:, None] + back[:, None] * p_shared

    contexts, iv = np.unique(v, return_inverse=True)
    by = np.stack([np.bincount(iv, c, len(contexts)) for c in n])
    q = (by + s[:, None]) / (by.sum(axis=0) + 1)
    both = n.sum(axis=0)
    lean = (q[1][iv] * ((a[1] + d[1]) * s[0] / ((a[0] + d[0]) * s[1]))[iw]).astype(np.float32)  # as much as its words' counts lean
    share = lean / (lean + q[0][iv].astype(np.float32))
    toxic = toward(n[1], share * both, both * share * (1 - share), noise)
    b = np.stack([both - toxic, toxic])
    d = np.float32(_discount(both)) * np.stack([1 - share, share])
    total = np.stack([np.bincount(iv, c, len(contexts)) for c in b])
    some = np.where(total > 0, total, 1)
    p_back = np.where(total > 0, np.stack([np.bincount(iv, c, len(contexts)) for c in np.minimum(b, d)]) / some, 1)
    p_pair = np.stack([(np.maximum(b[c] - d[c], 0) / some[c][iv] + p_back[c][iv] * p_word[c][iw]).astype(np.float32) for c in (0, 1)])
    keys = _pair(v, w)
    order = np.argsort(keys)
    return KneserNey(words, p_word, back, contexts, p_back, keys[order], p_pair[:, order])


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


@dataclass
class Model:
    """Log-likelihood ratios, toxic to ordinary, of pairs, contexts and words, and the calibration of their mean."""

    words: np.ndarray
    word: np.ndarray
    unknown: float = 0.0
    contexts: np.ndarray | None = None
    context: np.ndarray | None = None
    pairs: np.ndarray | None = None
    pair: np.ndarray | None = None
    calibration: np.ndarray | None = None  # probability of each bin

    @classmethod
    def of(cls, kn: KneserNey) -> Model:
        ratio = lambda p: np.log(p[1] / p[0]).astype(np.float32)
        return cls(kn.words, ratio(kn.p_word), float(np.log(kn.back[1] / kn.back[0])), kn.contexts, ratio(kn.p_back), kn.pairs, ratio(kn.p_pair))

    @classmethod
    def empty(cls) -> Model:
        none, zero = np.empty(0, np.uint64), np.empty(0, np.float32)
        return cls(none, zero, 0.0, none, zero, none, zero)

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-likelihood ratio per word of each text."""
        _, v, w, doc = triples_of(texts)
        n = np.maximum(1, np.bincount(doc, minlength=len(texts)))
        # each distinct pair is looked up once
        keys, first, back = np.unique(_pair(v, w), return_index=True, return_inverse=True)
        backed = _look_up(self.contexts, self.context, v[first], 0.0) + _look_up(self.words, self.word, w[first], self.unknown)
        found = _look_up(self.pairs, self.pair, keys, np.nan)
        return np.bincount(doc, np.where(np.isnan(found), backed, found)[back], len(texts)) / n

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Probabilities; a small strictly rising part keeps the order within a step."""
        if self.calibration is None:
            return np.full(len(evidence), 0.25)
        fine = 1 / (1 + np.exp(-4 * np.clip(evidence, -5, 5)))
        return np.clip(0.99 * self.calibration[bin_of(evidence)] + 0.01 * fine, 0, 1)


    def load(self) -> Model:
        return self


@dataclass
class Stored:
    """A model in the shared folder, for tasks to read: only its path and calibration pass through the driver."""

    path: str
    calibration: np.ndarray | None = None

    def load(self) -> Model:
        system, path = open_folder(self.path)
        with system.open_input_file(path) as source:
            model = pickle.loads(source.read())
        model.calibration = self.calibration
        return model


BINS = 800


def bin_of(evidence: np.ndarray) -> np.ndarray:
    """Bins that are narrow around 0 and wider away from it."""
    return np.clip(np.floor(40 * np.arcsinh(2000 * evidence)) + BINS // 2, 0, BINS - 1).astype(np.int64)


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The rising step function nearest to positive / total, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(total):
        blocks.append([float(positive[k]), float(total[k]), k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, t, _ = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += t
    out = np.empty(len(total))
    start, rate = 0, 0.0
    for j, (p, t, k) in enumerate(blocks):
        out[start : int(k)] = rate if j else p / t
        start, rate = int(k), p / t
    out[start:] = rate
    return out


def _sample(texts: DataFrame, labels: DataFrame, bound: int) -> tuple[DataFrame, list[float]] | None:
    """text, toxic, half of the labelled rows that are learnt from, and the sampling rate of either class; None without both classes."""
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    train = train.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    half = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 > 2).cast("int")
    known = texts.withColumn("n", F.length("text").cast("long")).where(F.col("n") <= bound // 4).join(train, "doc_id").withColumn("half", half)
    chars = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    target = min(bound, chars.get(0) or 0, chars.get(1) or 0)
    if not target:
        return None
    rates = [target / chars[0], target / chars[1]]
    cut = F.when(F.col("toxic") == 1, int(rates[1] * (1 << 30))).otherwise(int(rates[0] * (1 << 30)))
    return table(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= cut).select("text", "toxic", "half"), "labelled"), rates


def _spreads(sample: DataFrame) -> DataFrame:
    """w, spread: the sum of the squares of the distinct words before w in each document, divided by their sum.

    Documents are drawn as wholes, so a class's count of w varies by that much more than if its contexts were drawn.
    """

    def task(batches):
        for batch in sliced(batches):
            _, v, w, doc = triples_of(utf8(batch.column(0)))
            pairs = np.unique(np.stack([doc.astype(np.int64), w.view(np.int64), v.view(np.int64)], axis=1), axis=0)
            if len(pairs):
                starts = np.flatnonzero(np.append(True, (np.diff(pairs[:, :2], axis=0) != 0).any(axis=1)))
                n = np.diff(np.append(starts, len(pairs)))
                words, at = np.unique(pairs[starts, 1], return_inverse=True)
                sums = [np.bincount(at, x, len(words)) for x in (n, n.astype(float) ** 2)]
                yield pa.RecordBatch.from_arrays([pa.array(words), *map(pa.array, sums)], ["w", "n", "squares"])

    rows = small_batches(sample.select("text")).mapInArrow(task, "w long, n double, squares double")
    return rows.groupBy("w").agg((F.sum("squares") / F.sum("n")).cast("float").alias("spread"))


def _class_counts(sample: DataFrame) -> DataFrame:
    """v, w, for halves 0 and 1 and both (2) and either class the distinct words before that pair (n00 to n21), and w's spread."""

    def task(batches):
        for batch in sliced(batches):
            u, v, w, doc = triples_of(utf8(batch.column(0)))
            kind = (2 * batch.column(2).to_numpy() + batch.column(1).to_numpy())[doc]
            keys = np.stack([v.view(np.int64), w.view(np.int64), u.view(np.int64), (1 << kind).astype(np.int64)], axis=1)
            keys = np.unique(keys, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, k]) for k in range(4)], ["v", "w", "u", "kind"])

    rows = small_batches(sample.select("text", "toxic", "half")).mapInArrow(task, "v long, w long, u long, kind long")
    rows = rows.groupBy("v", "w", "u").agg(F.bit_or("kind").alias("kind"))
    of = {f"n{h}{c}": mask for h, by in enumerate(((1, 2), (4, 8), (5, 10))) for c, mask in enumerate(by)}
    counts = rows.groupBy("v", "w").agg(*[F.sum(F.when(F.col("kind").bitwiseAND(F.lit(m)) != 0, 1).otherwise(0)).cast("int").alias(k) for k, m in of.items()])
    return table(counts.join(_spreads(sample), "w").select(*counts.columns, "spread"), "class-counts")


def _with_shared(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """``counts`` and p, the shared probability of w. Neither the words nor their counts leave the executors."""
    every = cells.groupBy("w").agg(_contexts(F.sum("n")).alias("contexts"))
    totals = every.agg(F.sum("contexts").alias("n"), F.count("*").alias("words")).first()
    p = (F.coalesce("contexts", F.lit(0.0)) + 0.5) / F.lit((totals.n or 0.0) + 0.5 * (totals.words + 1))
    cell = F.shiftrightunsigned("w", CONTEXT_BITS)
    return counts.withColumn("cell", cell).join(every.withColumnRenamed("w", "cell"), "cell", "left").select(*counts.columns, p.alias("p"))


def _models(counts: DataFrame, folder: str) -> list[Stored | None]:
    """The models of either half and of both, estimated and stored by one task: what it takes is bounded by the sample."""

    def task(batches):
        given = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        v, w, *n, spread, p = [np.concatenate(c) for c in zip(*given)]
        del given
        words, first = np.unique(w.view(np.uint64), return_index=True)
        shared, spread = (words, p[first]), spread[first].astype(float)
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        for k in range(3):
            own = np.stack(n[2 * k : 2 * k + 2])
            name = None
            if own.sum(axis=1).all():
                name = f"{k}-{uuid.uuid4().hex}"  # of this attempt
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(pickle.dumps(Model.of(estimate(v.view(np.uint64), w.view(np.uint64), own, shared, spread=spread))))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name], pa.string())], ["k", "name"])

    rows = counts.repartition(1).mapInArrow(task, "k int, name string").collect()
    return [Stored(f"{folder}/{r.name}") if r.name else None for r in sorted(rows, key=lambda r: r.k)]


def fit(docs: DataFrame, labels: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model | Stored:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sampled = _sample(texts, labels, sample_chars)
    if sampled is None:
        return Model.empty()
    sample, rates = sampled
    counts = _class_counts(sample)
    if counts.isEmpty():
        return Model.empty()
    chars = texts.agg(F.sum(F.length("text").cast("long")).alias("n")).first().n or 0
    cells = table(shared_counts(texts, chars), "shared-counts")
    halves = _models(_with_shared(counts, cells), scratch(docs.sparkSession, "models"))
    model = halves[2]
    if model is None:
        return Model.empty()
    model.calibration = _calibrate(sample, rates, [halves[0] or model, halves[1] or model])
    return model


def _calibrate(sample: DataFrame, rates: list[float], halves: list[Stored]) -> np.ndarray:
    """Each half's documents by the other half's model: counts of bins and labels, then isotonic regression."""

    def task(batches):
        models = [m.load() for m in halves]
        for batch in sliced(batches):
            toxic, half = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            texts = utf8(batch.column(0))
            found = np.empty(len(texts))
            for k in (0, 1):
                own = np.flatnonzero(half == k)
                if len(own):
                    found[own] = models[1 - k].evidence([texts[i] for i in own.tolist()])
            keys, times = np.unique(bin_of(found) * 2 + toxic, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64))], ["key", "n"])

    rows = small_batches(sample.select("text", "toxic", "half")).mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(2 * BINS)
    for r in rows:
        counts[r.key] = r.n / rates[r.key % 2]
    return isotonic(counts[1::2], counts[0::2] + counts[1::2])


def score(docs: DataFrame, model: Model | Stored) -> DataFrame:
    """doc_id, score of each row of ``docs`` (doc_id, text)."""

    def task(batches):
        own = model.load()
        for batch in sliced(batches):
            found = own.score(own.evidence(utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(task, "doc_id long, score double")


def keep(docs: DataFrame, model: Model | Stored, cutoff: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``cutoff``, with all their columns."""

    def task(batches):
        own = model.load()
        for batch in sliced(batches, text_col):
            texts = utf8(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array(own.score(own.evidence(texts)) < cutoff))

    return small_batches(docs).mapInArrow(task, T.StructType(docs.schema.fields))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    return keep(docs, fit(docs, labels))
