"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, calibrated by a temperature.

N-grams of 1 to 3 characters are hashed into BUCKETS; characters are code points, A-Z and the Latin-1 capitals lower-cased,
ASCII characters that aren't letters made blank. Weights are learned by follow-the-regularised-leader (proximal, per
coordinate) with L1 and L2 penalties; a part of the sample is left out of that and sets the temperature.

Scale: document frequencies are counted over all training rows, added up by bucket. The classifier is fitted on a bounded
sample: of each language the `max_per_language` distinct texts whose hashes are lowest (of the rows that hash among the
language's lowest 4 * `max_per_language`, so fewer where three rows of four are copies), or fewer where so many languages
would make more than `max_rows` of them in all; both are parameters, and every language of the training rows is learned. What
reaches the driver are those texts' sparse features. What is shipped back are BUCKETS weights a language. Scoring is one scan
over whole texts without a shuffle.

Cases: a text that is null or has no letter is `und` with score 0. Rows whose language is null don't train. With no
training row every language is `und`; with one language, that one has score 1. Repeated rows are each scored, and are one text
of the sample. A text whose bytes aren't UTF-8 is read as Latin-1, whatever its neighbours are. Columns of the input named as
the added ones give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from . import words as W
from .common import materialised, per_batch, small_batches, with_arrays

BUCKETS = 1 << 14
MAX_PER_LANGUAGE = 1000
MAX_ROWS = 50_000
UNDETERMINED = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in them) of UTF-8 texts, normalised."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).copy()
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    except UnicodeDecodeError:  # text by text
        each = []
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            try:
                each.append(raw[a:z].decode())
            except UnicodeDecodeError:
                each.append(raw[a:z].decode("latin-1"))
        points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32).copy()
        at = np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
    upper = ((points >= 0x41) & (points <= 0x5A)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    points[upper] += 32
    points[(points < 0x61) | ((points > 0x7A) & (points < 0xAA))] = 0x20
    return points, at


def counts(column: pa.Array, rows: int = 256):
    """(first row, end row, n-gram counts by row and bucket, letters by row) of some rows at a time."""
    for lo, hi, data, offsets in W.chunks(column):
        points, at = characters(data, offsets)
        h = points.astype(np.uint32) * _MULTIPLIERS[0]
        grams = [h]
        for n in (1, 2):
            h = (h[:-1] ^ (points[n:] + np.uint32(n))) * _MULTIPLIERS[n] if len(h) > 1 else h[:0]
            h = h ^ (h >> np.uint32(15))
            grams.append(h)
        buckets = [((g * np.uint32(0x27D4EB2F)) >> np.uint32(18)).astype(np.int64) for g in grams]
        letter = np.concatenate(([0], np.cumsum(points != 0x20)))
        for a in range(0, hi - lo, rows):
            z = min(hi - lo, a + rows)
            out = np.zeros((z - a, BUCKETS), np.float32)
            letters = np.zeros(z - a, bool)
            for i in range(a, z):
                x, y = int(at[i]), int(at[i + 1])
                if letter[y] == letter[x]:
                    continue
                part = points[x:y]
                if not ((part >= 0x61) & (part <= 0x7A)).any():
                    letters[i - a] = any(chr(c).isalpha() for c in np.unique(part).tolist())
                    if not letters[i - a]:
                        continue
                letters[i - a] = True
                out[i - a] = np.bincount(np.concatenate([b[x : max(x, y - n)] for n, b in enumerate(buckets)]), minlength=BUCKETS)
            yield lo + a, lo + z, out, letters


def features(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf.astype(np.float32)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


class FollowTheRegularisedLeader:
    """Per-coordinate proximal FTRL for the multinomial logistic loss."""

    def __init__(self, size: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def temperature_of(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by a search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    lo, hi, golden = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, epochs: int = 4, calibration: int = 5, seed: int = 3) -> LanguageModel:
    """From (buckets, counts) of texts and their languages; every calibration-th of a shuffle sets the temperature."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    xs = []
    for at, count in samples:
        x = np.log1p(count.astype(np.float64)) * idf[at]
        xs.append((np.concatenate((at.astype(np.int64), [BUCKETS])), np.concatenate((x / max(np.sqrt((x * x).sum()), 1e-12), [1.0]))))
    order = np.random.default_rng(seed).permutation(len(xs))
    aside = order[::calibration] if len(order) >= 20 else order[:0]
    learned = np.setdiff1d(order, aside)
    leader = FollowTheRegularisedLeader(BUCKETS + 1, len(languages))
    for e in range(epochs):
        for i in np.random.default_rng(seed + e).permutation(learned):
            leader.learn(*xs[i], y[i])
    w = leader.weights()
    scores = np.array([x @ w[at] for at, x in (xs[i] for i in aside)]).reshape(len(aside), len(languages))
    return LanguageModel(languages, idf, w[:-1].astype(np.float32), w[-1], temperature_of(scores, y[aside]) if len(languages) > 1 else 1.0)


def learn(docs: DataFrame, language: str = "lang", text: str = "text", max_per_language: int = MAX_PER_LANGUAGE, max_rows: int = MAX_ROWS, **options) -> LanguageModel:
    """A model from the rows of docs that have a language."""
    small_batches(docs.sparkSession)
    order = F.xxhash64(text, F.lit("sample"))
    rows = docs.where(F.col(language).isNotNull()).select(F.col(text).alias("text"), F.col(language).alias("lang"), order.alias("place"))

    def frequencies(batches):
        total, seen = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, _, count, letters in counts(batch.column(0)):
                total += (count > 0).sum(0)
                seen += int(letters.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [BUCKETS])), pa.int32()), pa.array(np.concatenate((total[at], [seen])), pa.int64())], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sizes = materialised(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    languages = sizes.count()
    if not languages:
        return fit([], [], idf)
    if languages > max_rows:
        raise ValueError(f"{languages} languages can't be learned from at most {max_rows} rows")
    quota = max(1, min(max_per_language, max_rows // languages))
    # only (language, hash) is sorted, of the rows that hash among the lowest 4 * quota of their language
    low = F.shiftrightunsigned(F.col("place").bitwiseXOR(F.lit(-1 << 63)), 11) < 4 * quota / F.col("rows") * float(1 << 53)
    near = rows.where(F.col("text").isNotNull()).select("lang", "place").join(F.broadcast(sizes), "lang").where(low)  # sizes: a row a language
    ranked = near.select("lang", "place").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
    ends = ranked.where(F.col("rank") <= quota).groupBy("lang").agg(F.max("place").alias("end"))
    drawn = rows.join(F.broadcast(ends), "lang").where("place <= end")  # a row a language, at most max_rows

    def sampled(batch: pa.RecordBatch):
        out = [], [], [], []
        for lo, _, count, letters in counts(batch.column(0)):
            for i in np.flatnonzero(letters).tolist():
                at = np.flatnonzero(count[i])
                out[0].append(batch.column(1)[lo + i].as_py())
                out[1].append(batch.column(2)[lo + i].as_py())
                out[2].append(at.astype(np.uint16).tobytes())
                out[3].append(count[i][at].astype(np.float32).tobytes())
        kinds = pa.string(), pa.int64(), pa.binary(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=["lang", "place", "at", "count"])

    kept = drawn.select("text", "lang", "place").mapInArrow(per_batch(sampled), "lang string, place bigint, at binary, count binary").dropDuplicates(["lang", "place"]).toPandas()
    kept = kept.sort_values(["lang", "place"], kind="stable")
    samples = [(np.frombuffer(a, np.uint16), np.frombuffer(c, np.float32)) for a, c in zip(kept["at"], kept["count"])]
    return fit(samples, kept["lang"].tolist(), idf, **options)


def predicted(docs: DataFrame, model: LanguageModel, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the most likely language of `text` and its calibrated probability."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    def run(texts: pa.Array) -> list[pa.Array]:
        m = held.value
        found, p = np.full(len(texts), -1), np.zeros(len(texts))
        for lo, hi, count, letters in counts(texts) if m.languages else ():
            s = (features(count, m.idf) @ m.weights + m.bias) / m.temperature
            e = np.exp(s - s.max(1, keepdims=True))
            best = e.argmax(1)
            found[lo:hi] = np.where(letters, best, -1)
            p[lo:hi] = np.where(letters, e[np.arange(hi - lo), best] / e.sum(1), 0.0)
        known = [*m.languages, UNDETERMINED]
        return [pa.array([known[i] for i in found.tolist()]), pa.array(p)]

    added = [StructField(language, StringType()), StructField(score, DoubleType())]
    return with_arrays(docs, [c for c in docs.columns if c not in (language, score)], [text], added, run)
