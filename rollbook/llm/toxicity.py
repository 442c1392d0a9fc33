"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary text; the other on toxic text, with the ordinary one
behind it.  Toxic documents are mostly ordinary words, so what the second is trained on are
the runs that ordinary documents do not have: byte strings seen in many different contexts of toxic
documents and in few of ordinary ones (copies of one passage share their contexts and
count once).  A text is cut into windows, each compressed with either dictionary; what the
second saves is near zero on ordinary windows.  How often a saving occurs in windows of toxic and of ordinary documents
makes it evidence for or against, and a text is judged by the stretch of windows with most evidence, whose chance
maximum grows with the logarithm of the length: a toxic passage in a long text counts as it does alone.  A logistic curve fitted
on other training documents turns this and the mean savings into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import labelled

#: Bytes of a window and of its overlap with the next; compression level.
WINDOW, OVERLAP, LEVEL = 64, 12, 6
#: Bound of the training sample: documents per label, and slices of each.  Every third calibrates.
PER_LABEL, SLICES, SLICE_CHARS = 1500, 4, 4096
#: A run is made of strings of this many bytes, told apart by the bytes before them.
RUN_BYTES, CONTEXT_BYTES = 6, 5
#: A string is toxic from so many contexts per thousand toxic documents (3 at least), so many times those in ordinary ones.
CONTEXTS, TIMES = 60, 10
#: Savings of a window are told apart between these numbers of bytes.
LEAST_SAVED, MOST_SAVED = -4, 12
#: Bytes of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 8192, 1024


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _windows(data: bytes) -> list[bytes]:
    return [data[i : i + WINDOW + OVERLAP] for i in range(0, len(data), WINDOW)]


def _contexts(texts: list[bytes]) -> Counter:
    """Different contexts of every string of ``RUN_BYTES`` bytes."""
    seen, size = set(), CONTEXT_BYTES + RUN_BYTES
    for text in texts:
        padded = b" " * CONTEXT_BYTES + text
        seen.update(padded[i : i + size] for i in range(len(padded) - size + 1))
    return Counter(s[CONTEXT_BYTES:] for s in seen)


def _runs(text: bytes, strange: set[bytes]) -> list[bytes]:
    """The longest stretches of ``text`` all of whose strings are in ``strange``."""
    found, i = [], 0
    while i <= len(text) - RUN_BYTES:
        if text[i : i + RUN_BYTES] not in strange:
            i += 1
            continue
        start = i
        while text[i : i + RUN_BYTES] in strange:
            i += 1
        found.append(text[start : i + RUN_BYTES - 1])
    return found


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: The evidence of a window by its saving: logarithms of how many times more often toxic documents have it.
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(MOST_SAVED - LEAST_SAVED + 1))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))
        return made[0], made[1]


def savings(data: bytes, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """What the toxic dictionary saves on every window of a text, in bytes."""
    return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in _windows(data)], np.int64)


def _places(saved: np.ndarray) -> np.ndarray:
    return np.clip(saved, LEAST_SAVED, MOST_SAVED) - LEAST_SAVED


def evidence(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> np.ndarray:
    """The logarithm of how many times more often windows of toxic texts save so much, half a window added to each."""
    size = MOST_SAVED - LEAST_SAVED + 1
    ours, others = (np.bincount(_places(np.concatenate([*texts, np.zeros(0, np.int64)])), minlength=size) + 0.5 for texts in (toxic, ordinary))
    return np.log(ours / ours.sum()) - np.log(others / others.sum())


def strongest(ratios: np.ndarray) -> float:
    """The largest sum of neighbours."""
    sums = np.concatenate(([0.0], np.cumsum(ratios)))
    return float((sums - np.minimum.accumulate(sums)).max())


def features(saved: np.ndarray, ratios: np.ndarray) -> tuple[float, float, float]:
    """Mean saving of the windows, mean of what goes beyond one byte, and the strongest stretch less what length alone brings."""
    if not len(saved):
        return 0.0, 0.0, 0.0
    return float(saved.mean()), float(np.clip(saved - 1, 0, 8).mean()), strongest(ratios[_places(saved)]) - float(np.log1p(len(saved)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised logistic regression by Newton steps; the first weight is the offset."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic`` 0 or 1, all for training).

    The sample is bounded: about ``PER_LABEL`` documents per label, of each at most ``SLICES`` slices of
    ``SLICE_CHARS`` characters spread over it, the whole of all but very long texts.  Without
    documents of both labels there is no model.
    """
    sample = labelled(docs.where(F.length("text") > 0), labels, "toxic", PER_LABEL, "text")
    step = f"greatest({SLICE_CHARS}, length(text) div {SLICES})"
    slices = [F.expr(f"substring(text, {k} * {step} + 1, {SLICE_CHARS})") for k in range(SLICES)]
    rows = sample.select("key", "label", F.concat(*slices).alias("text")).collect()
    got = sorted((str(r["key"]), r["label"], _bytes(r["text"])) for r in rows)
    teach, fit = [g for i, g in enumerate(got) if i % 3], [g for i, g in enumerate(got) if i % 3 == 0]
    toxic, ordinary = sorted({t for _, y, t in teach if y}), sorted({t for _, y, t in teach if not y})
    if not toxic or not ordinary:
        return None
    ours, others = _contexts(toxic), _contexts(ordinary)
    least, share = max(3, CONTEXTS * len(toxic) / 1000), TIMES * len(toxic) / len(ordinary)
    strange = {s for s, n in ours.items() if n >= least and n >= share * (others[s] + 0.5)}
    runs = [run for text in toxic for run in _runs(b" " + text + b" ", strange)]
    runs = [b"".join(runs[i : i + 4]) for i in range(0, len(runs), 4)]
    plain = [w for text in ordinary for w in _windows(text)[:20]]
    model = Model(_dictionary(plain, ORDINARY_BYTES, 64), _dictionary(runs, TOXIC_BYTES, 16) if runs else b"")
    pair = model.compressors()
    model.ratios = evidence(*([savings(t, *pair) for _, y, t in teach if y == label] for label in (1, 0)))
    x, y = np.array([features(savings(t, *pair), model.ratios) for _, _, t in fit or teach]), np.array([y for _, y, _ in fit or teach])
    model.weights = _logistic(x, y)
    # The sample holds more toxic documents than the labels do: the offset goes back to their share.
    share = labels.where(F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    if 0 < share < 1 and 0 < y.mean() < 1:
        model.weights[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return model


def _score(model: Model | None):
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors() if model else ()
        for frame in frames:
            scores = np.zeros(frame.num_rows)
            if model:
                x = np.array([features(savings(_bytes(t.as_py() or ""), *pair), model.ratios) for t in frame.column(0)]).reshape(-1, 3)
                scores = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*frame.columns[1:], pa.array(scores)], [*frame.schema.names[1:], "score"])

    return batches


def score(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score``, from 0 to 1, for the whole ``text`` of every row.

    Null and empty texts have no windows and the score of a text that saves nothing; without a
    model every score is 0.  Repeated rows come back repeated; nothing but ``text`` is read.
    """
    rows = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "score double"])
    return rows.mapInArrow(_score(model), kinds)
