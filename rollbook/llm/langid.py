"""Language of whole texts by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes.  Two recurrent layers read each window, one
from either end, and every byte position gets a probability per language; a document's
probability is the mean over its letter positions.  The gates use piecewise linear
activations, so a step is a table look-up, one small matrix product and a few additions on a
batch of windows.  Training is backpropagation through time in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import stratified

#: Label of a text that is null or has no letter.
UNKNOWN = "und"
#: Bytes read at a time; windows in a batch; units of either direction.
WINDOW, BATCH, UNITS = 128, 2048, 8
#: Bound of the training sample: documents per language, and windows taken from each.
PER_LANGUAGE, WINDOWS_EACH = 300, 4
STEPS, TRAIN_BATCH, RATE = 200, 192, 0.02

_LETTER = regex.compile(r"\p{L}")
_LETTER_BYTE = np.array([chr(b).isalpha() or b >= 0xC2 if b < 0x80 or b >= 0xC2 else True for b in range(256)])
_LETTER_BYTE[0x80:0xC2] = False


@dataclass
class Network:
    """Weights: per direction a table of inputs (3H x 256), recurrent weights (3H x H); an output layer."""

    labels: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0.0, 1.0, out=x)


def _run(table: np.ndarray, weights: np.ndarray, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction over ``codes`` (T, B); ``keep`` collects what training needs."""
    units, (length, batch) = weights.shape[1], codes.shape
    states = np.empty((length, units, batch), np.float32)
    h = np.zeros((units, batch), np.float32)
    x, g = np.empty((3 * units, batch), np.float32), np.empty((3 * units, batch), np.float32)
    for t in range(length):
        np.take(table, codes[t], axis=1, out=x, mode="clip")
        np.matmul(weights, h, out=g)
        gates = g[: 2 * units] + x[: 2 * units]
        _gate(gates)
        z, r = gates[:units], gates[units:]
        n = r * g[2 * units :]
        n += x[2 * units :]
        np.clip(n, -1.0, 1.0, out=n)
        if keep is not None:
            keep.append((h.copy(), z.copy(), r.copy(), n.copy(), g[2 * units :].copy()))
        h = states[t]
        np.subtract(keep[-1][0] if keep is not None else (states[t - 1] if t else 0.0), n, out=h)
        h *= z
        h += n
    return states


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=-2, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=-2, keepdims=True)
    return scores


def position_probabilities(net: Network, codes: np.ndarray) -> np.ndarray:
    """Probabilities (T, C, B) of every position of the windows ``codes`` (T, B)."""
    ahead = _run(net.tables[0], net.recurrent[0], codes)
    back = _run(net.tables[1], net.recurrent[1], codes[::-1])[::-1]
    units = ahead.shape[1]
    scores = np.matmul(net.out[:, :units], ahead) + np.matmul(net.out[:, units:], back)
    return _softmax(scores + net.bias[:, None])


def _backward(table, weights, codes, kept, outer, grads) -> None:
    """Backpropagation through time of one direction; ``outer`` (T, H, B) is the loss gradient of the states."""
    units = weights.shape[1]
    d_table, d_weights = grads
    carried, inputs = np.zeros_like(outer[0]), np.empty((3 * units, *codes.shape), np.float32)
    for t in range(len(codes) - 1, -1, -1):
        h, z, r, n, inner = kept[t]
        d = outer[t] + carried
        dz = d * (h - n) * 0.25 * ((z > 0) & (z < 1))
        dn = d * (1 - z) * (np.abs(n) < 1)
        dr = dn * inner * 0.25 * ((r > 0) & (r < 1))
        inputs[:, t] = np.concatenate([dz, dr, dn])
        at_state = np.concatenate([dz, dr, dn * r])
        d_weights += at_state @ h.T
        carried = d * z + weights.T @ at_state
    for row in range(3 * units):
        d_table[row] += np.bincount(codes.ravel(), weights=inputs[row].ravel(), minlength=256)


def train(windows: np.ndarray, targets: np.ndarray, labels: list[str], *, seed: int = 7) -> Network:
    """Fit on ``windows`` (N, T) of bytes and ``targets`` (N,) of label positions."""
    rng, units, classes = np.random.default_rng(seed), UNITS, len(labels)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    tables = [normal(3 * units, 256, scale=0.3) for _ in range(2)]
    for table in tables:
        table[:units] += 2.0  # remember at first
    recurrent = [normal(3 * units, units, scale=0.4) for _ in range(2)]
    params = [*tables, *recurrent, normal(classes, 2 * units, scale=0.3), np.zeros(classes, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    net = Network(labels, params[:2], params[2:4], params[4], params[5])
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(windows), TRAIN_BATCH)
        codes, truth = np.ascontiguousarray(windows[pick].T), targets[pick]
        kept = [[], []]
        ahead = _run(net.tables[0], net.recurrent[0], codes, kept[0])
        back = _run(net.tables[1], net.recurrent[1], codes[::-1], kept[1])[::-1]
        both = np.concatenate([ahead, back], axis=1)
        d = _softmax(np.matmul(net.out, both) + net.bias[:, None])
        d[:, truth, np.arange(len(truth))] -= 1.0
        d /= d.shape[0] * d.shape[2]
        grads = [np.zeros_like(p) for p in params]
        grads[4] += np.einsum("tcb,thb->ch", d, both)
        grads[5] += d.sum(axis=(0, 2))
        outer = np.matmul(net.out.T, d)
        _backward(net.tables[0], net.recurrent[0], codes, kept[0], outer[:, :units], (grads[0], grads[2]))
        _backward(net.tables[1], net.recurrent[1], codes[::-1], kept[1], outer[::-1, units:], (grads[1], grads[3]))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / max(norm, 1e-9))
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame) -> Network | None:
    """A network for the languages of ``docs`` (``doc_id``, ``text``, ``lang``; all rows are for training).

    The sample is bounded: about ``PER_LANGUAGE`` documents of each language and up to
    ``WINDOWS_EACH`` windows of each, at places spread over the text.  Rows without language or letters
    teach nothing; without any row there is no network.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("doc_id").alias("key"), "text", F.col("lang").cast("string").alias("lang"))
    sample = stratified(rows, "lang", PER_LANGUAGE, key="key")
    starts = [f"cast(length(text) * {k / WINDOWS_EACH} as int) + 1" for k in range(WINDOWS_EACH)]
    parts = sample.select("lang", *[F.expr(f"substring(text, {s}, {WINDOW})").alias(f"w{k}") for k, s in enumerate(starts)])
    got = [(r["lang"], r[f"w{k}"]) for r in parts.collect() for k in range(WINDOWS_EACH)]
    got = sorted((lang, text) for lang, text in got if text and _LETTER.search(text))
    if not got:
        return None
    labels = sorted({lang for lang, _ in got})
    by_label = {lang: [t for x, t in got if x == lang] for lang in labels}
    each = max(map(len, by_label.values()))
    chosen = [(k, by_label[x][i % len(by_label[x])]) for k, x in enumerate(labels) for i in range(each)]
    windows = np.full((len(chosen), WINDOW), 32, np.uint8)
    for row, (_, text) in enumerate(chosen):
        data = np.frombuffer(text.encode("utf-8", "replace")[:WINDOW], np.uint8)
        windows[row, : len(data)] = data
    return train(windows, np.array([k for k, _ in chosen]), labels)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean position probabilities (N, C) of whole texts over their letter bytes."""
    classes = len(net.labels)
    sums, letters = np.zeros((len(texts), classes)), np.zeros(len(texts))
    held, owners, size = [], [], 0

    def flush() -> None:
        nonlocal held, owners, size
        joined = np.frombuffer(b"".join(held), np.uint8)
        codes = np.ascontiguousarray(joined.reshape(-1, WINDOW).T)
        weight = _LETTER_BYTE[codes].astype(np.float32)
        found = np.einsum("tcb,tb->bc", position_probabilities(net, codes), weight, optimize=True)
        owner = np.repeat(owners, [len(h) // WINDOW for h in held])
        np.add.at(sums, owner, found)
        np.add.at(letters, owner, weight.sum(axis=0))
        held, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for low in range(0, len(text), WINDOW * BATCH):
            part = text[low : low + WINDOW * BATCH]
            part += b" " * (-len(part) % WINDOW)
            if size and size + len(part) > WINDOW * BATCH:
                flush()
            held.append(part)
            owners.append(i)
            size += len(part)
    if held:
        flush()
    return sums / np.maximum(letters, 1)[:, None]


def _judge(net: Network | None):
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(frame.schema.get_field_index("__text")).to_pylist()
            known = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t)]
            labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                found = pooled(net, [texts[i].encode("utf-8", "surrogatepass") for i in known])
                for i, row in zip(known, found, strict=True):
                    best = int(row.argmax())
                    labels[i], scores[i] = net.labels[best], min(1.0, float(row[best]))
            kept = [c for n, c in zip(frame.schema.names, frame.columns, strict=True) if n != "__text"]
            names = [n for n in frame.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(labels), pa.array(scores)], [*names, "lang_pred", "score"])

    return batches


def predict(docs: DataFrame, net: Network | None, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score`` from the whole ``text``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when
    there is no network.  Ties go to the first label in code point order.  ``lang_pred`` and
    ``score`` of ``docs`` are not read; they must not be among ``keep``.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(_judge(net), f"{kinds}, lang_pred string, score double")


def known_language(docs: DataFrame, net: Network | None, *, min_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``min_score`` or more, unchanged.

    Texts without a letter go, and texts in which no learned language prevails.  Without a
    network nothing can be told, and only texts without a letter go.
    """
    names = docs.columns
    coded = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    coded = coded.withColumn("text", F.col(f"c{names.index('text')}"))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = predict(coded, net, keep=tuple(f"c{i}" for i in range(len(names))))
    judged = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return judged.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
