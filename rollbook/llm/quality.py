"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

The score of a feature vector x is a logistic curve over

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

which is every weighted pair of features at rank f, in time linear in the features present.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import labelled

#: Hash buckets of words, rank of the pairs, bound of the training sample per label.
WORD_BUCKETS, RANK, PER_LABEL = 1 << 12, 4, 2000
EPOCHS, BATCH, RATE = 12, 64, 0.05
_STATS = 12
#: Bins of a statistic: each has a feature of its own, so that pairs can bend.
_EDGES = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])
_BINS = len(_EDGES) + 1


def _statistics(text: str, words: list[str], counts: Counter, chars: float | None) -> list[float]:
    """Shares from 0 to 1 that tell the structure of a text; the last is metadata: the stated length."""
    n = len(words)
    if not n:
        return [0.0] * (_STATS - 1) + [1.0 if chars else 0.0]
    length = sum(map(len, words))
    signs = sum(c for w, c in counts.items() if not w.isalnum() and not w[:-1].isalnum())
    shout = sum(c for w, c in counts.items() if w.isupper())
    return [
        len(counts) / n,
        max(counts.values()) / n,
        sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n,
        signs / n,
        shout / n,
        sum(c for w, c in counts.items() if not any(ch.isalnum() for ch in w)) / n,
        sum(c for w, c in counts.items() if any(ch.isdigit() for ch in w)) / n,
        sum(c for w, c in counts.items() if w[:1].isupper()) / n,
        min(1.0, length / n / 20),
        min(1.0, (text.count("\n") + 1) / n * 4),
        min(1.0, np.log1p(n) / 12),
        min(1.0, np.log1p(max(chars, 0.0) if chars is not None else len(text)) / 15),
    ]


def features(text: str | None, chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of what is not zero: hashed words, then a bin of every statistic, then its value."""
    words = (text or "").split()
    counts = Counter(words)
    stats = _statistics(text or "", words, counts, chars)
    hashed: dict[int, float] = {}
    for word, n in counts.items():
        at = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        hashed[at] = hashed.get(at, 0.0) + n
    values = np.log1p(np.fromiter(hashed.values(), np.float32, len(hashed)))
    values /= max(1e-6, float(np.sqrt((values * values).sum())))
    bins = np.searchsorted(_EDGES, stats) + np.arange(_STATS) * _BINS + WORD_BUCKETS
    plain = np.arange(_STATS) + WORD_BUCKETS + _STATS * _BINS
    at = np.concatenate([np.fromiter(hashed.keys(), np.int64, len(hashed)), bins, plain])
    return at, np.concatenate([values, np.full(_STATS, 0.5, np.float32), np.array(stats, np.float32)])


_SIZE = WORD_BUCKETS + _STATS * (_BINS + 1)


@dataclass
class Machine:
    offset: float
    linear: np.ndarray
    pairs: np.ndarray

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores before the logistic curve, by the sum-of-squares identity."""
        starts = np.cumsum([0, *(len(at) for at, _ in rows[:-1])])
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        vx = self.pairs[at] * x[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.offset + np.add.reduceat(self.linear[at] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, seed: int = 5) -> Machine:
    """Logistic loss by Adagrad on small batches."""
    rng = np.random.default_rng(seed)
    share = min(max(labels.mean(), 0.01), 0.99)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(_SIZE, np.float32), (rng.standard_normal((_SIZE, RANK)) * 0.05).astype(np.float32))
    seen = [np.full(_SIZE, 1e-2, np.float32), np.full((_SIZE, RANK), 1e-2, np.float32), 1e-2]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), BATCH):
            pick = order[low : low + BATCH]
            batch = [rows[i] for i in pick]
            error = 1 / (1 + np.exp(-np.clip(m.raw(batch), -30, 30))) - labels[pick]
            at, x = np.concatenate([r[0] for r in batch]), np.concatenate([r[1] for r in batch])
            lengths = [len(r[0]) for r in batch]
            vx = m.pairs[at] * x[:, None]
            sums = np.repeat(np.add.reduceat(vx, np.cumsum([0, *lengths[:-1]])), lengths, axis=0)
            each = np.repeat(error, lengths) / len(batch)
            own, back = np.unique(at, return_inverse=True)
            d_linear = np.bincount(back, each * x) + 1e-5 * m.linear[own]
            d_pairs = np.column_stack([np.bincount(back, each * x * (sums[:, f] - vx[:, f])) for f in range(RANK)]) + 1e-4 * m.pairs[own]
            seen[0][own] += d_linear**2
            seen[1][own] += d_pairs**2
            seen[2] += error.mean() ** 2
            m.linear[own] -= RATE * d_linear / np.sqrt(seen[0][own])
            m.pairs[own] -= RATE * d_pairs / np.sqrt(seen[1][own])
            m.offset -= RATE * float(error.mean()) / float(np.sqrt(seen[2]))
    return m


def _feature_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        rows = [features(t.as_py(), c.as_py()) for t, c in zip(frame.column(0), frame.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), *frame.columns[2:]],
            ["at", "x", *frame.schema.names[2:]],
        )


def learn(docs: DataFrame, labels: DataFrame, *, chars: str | None = None) -> Machine | None:
    """A machine from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``quality`` 0 or 1, all for training).

    ``chars`` names the metadata column with the stated length.  The sample is bounded: about
    ``PER_LABEL`` documents per label, whose features (not texts) come to the driver.  Without
    documents of both labels there is no machine.
    """
    stated = (F.col(chars) if chars else F.lit(None)).cast("double").alias("_chars")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"), stated)
    sample = labelled(rows, labels, "quality", PER_LABEL, "_text", "_chars")
    sample = sample.select("_text", "_chars", F.col("key").cast("string").alias("key"), "label")
    got = sample.mapInArrow(_feature_batches, "at array<bigint>, x array<float>, key string, label int").collect()
    got = sorted(got, key=lambda r: r["key"])
    truth = np.array([r["label"] for r in got])
    if len(set(truth.tolist())) < 2:
        return None
    return train([(np.array(r["at"], np.int64), np.array(r["x"], np.float32)) for r in got], truth)


def _score(machine: Machine | None):
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            scores = np.zeros(frame.num_rows)
            if machine and frame.num_rows:
                rows = [features(t.as_py(), c.as_py()) for t, c in zip(frame.column(0), frame.column(1), strict=True)]
                scores = 1 / (1 + np.exp(-np.clip(machine.raw(rows).astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*frame.columns[2:], pa.array(scores)], [*frame.schema.names[2:], "score"])

    return batches


def score(docs: DataFrame, machine: Machine | None, *keep: str, chars: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score``, from 0 to 1, for the whole ``text`` of every row.

    Null and empty texts are scored by their statistics, which are all zero; a null in ``chars``
    stands for the text's own length.  Without a machine every score is 0.  Repeated rows come
    back repeated.
    """
    stated = (F.col(chars) if chars else F.lit(None)).cast("double").alias("_chars")
    rows = docs.select(F.col("text").cast("string").alias("_text"), stated, *keep)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]), "score double"])
    return rows.mapInArrow(_score(machine), kinds)
