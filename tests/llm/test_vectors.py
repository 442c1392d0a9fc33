"""Value codes and whitening against plain versions."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from rollbook.llm import value_codes, whitening


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows):
    """Codes, errors, errors by label and digest, part by part with Python's integers."""
    kept = sorted(((i, v, label) for i, v, label in rows if usable(v)), key=lambda r: (r[0] is None, r[0], r[1]))
    x = [[math.floor(4096 * c) if abs(c) < 1e290 else int(c) * 4096 for c in v] for _, v, _ in kept]
    width = len(x[0])
    at = [width * p // 8 for p in range(9)]
    cut = [[row[at[p] : at[p + 1]] for row in x] for p in range(8)]
    books = [list(part[:16]) for part in cut]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), k) for k, e in enumerate(books[p])) for row in cut[p]] for p in range(8)]

    for _ in range(6):
        for p, best in enumerate(assign()):
            for e in range(len(books[p])):
                own = [row for row, (_, k) in zip(cut[p], best, strict=True) if k == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    best = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(best[p][r][0] for p in range(8)) for r in range(len(x))]
    of = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        of[label] += e
    long = lambda e: e if e < 1 << 63 else None
    return sorted(((i, "".join(f"{best[p][r][1]:02x}" for p in range(8)), long(errors[r]), long(of[label]), digest) for r, (i, _, label) in enumerate(kept)), key=str)


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, width)) * 0.2
    return [(i, (centres[i % 9] + 0.05 * rng.standard_normal(width)).astype(np.float32).tolist(), i % 4 or None) for i in range(n)]


BROKEN = [(900, None, 1), (901, [], 1), (902, [None] * 16, 1), (903, [float("nan")] * 16, 2), (904, [float("inf")] * 16, 2), (905, [0.1] * 3, 1)]


@pytest.mark.parametrize("case", ["plain", "odd", "few", "huge"])
def test_value_codes(spark, case):
    rows = vectors(200, 21 if case == "odd" else 16)
    if case == "few":
        rows = rows[:5]
    if case == "huge":
        rows += [(300, [2.0**41] * 16, 1), (301, [1e200] + [0.0] * 15, 3), (302, [-1e300] + [1e-300] * 15, 3)]
    rows += [rows[3], (rows[3][0], rows[4][1], 7), (None, rows[2][1], None)]
    df = spark.createDataFrame([(*r, "x", 5) for r in [*rows, *BROKEN]], "vec_id bigint, embedding array<double>, label int, code string, v int")
    got = sorted((tuple(r) for r in value_codes.compress(df.repartition(5)).collect()), key=str)
    assert got == plain_codes(rows)


def test_no_vectors(spark):
    for df in (spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"), spark.createDataFrame(BROKEN[:5], "vec_id bigint, embedding array<float>, label int")):
        assert value_codes.compress(df).count() == 0 and whitening.whiten(df).count() == 0


def test_pieces():
    for value in (0, -1, 5, 1 << 60, -(1 << 60), -(1 << 60) - 1, 3**200, -(3**200), (1 << 120) - 1):
        assert sum(p << 60 * i for i, p in enumerate(value_codes.pieces(value))) == value
        assert all(-(1 << 60) <= p < 1 << 60 for p in value_codes.pieces(value))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40, 130])
def test_leading_eigenvalues(n):
    rng = np.random.default_rng(n)
    for case in range(4):
        b = rng.standard_normal((n, n)) * (np.geomspace(1, 1e-5, n) if case == 1 else 1)
        a = b @ b.T
        if case == 2:  # equal ones and close ones
            q, _ = np.linalg.qr(b)
            a = q @ np.diag([3.0, 3.0, 3.0, 2.0, 2.0 - 1e-13, 1.0, 1.0 - 1e-9, 0.5][:n] + [0.1] * (n - 8)) @ q.T
            a = (a + a.T) / 2
        if case == 3:  # already diagonal
            a = np.diag(np.arange(n, 0, -1.0))
        found = whitening.leading(a)
        want = np.sort(np.linalg.eigvalsh(a))[::-1][: len(found)]
        assert np.allclose([e for e, _ in found], want, rtol=1e-12, atol=1e-13 * want[0])
        assert len(found) == min(8, n) or case == 1
        basis = np.stack([v for _, v in found])
        assert np.abs(basis @ basis.T - np.eye(len(found))).max() < 1e-6 and np.abs(a @ basis.T - basis.T * want).max() < 1e-11 * want[0] * n
        diagonal, off = whitening.tridiagonal(a)
        for s in (*want[1:4] * 1.0001, 0.3, -1.0):
            if np.abs(np.linalg.eigvalsh(a) - s).min() > 1e-9:
                assert whitening.count_above(diagonal, off, s, 1e-300) == (np.linalg.eigvalsh(a) > s).sum()


def test_whitening(spark):
    rows = vectors(300, 16)
    rows += [rows[3], (rows[3][0], rows[4][1], 7), (None, rows[2][1], None)]
    df = spark.createDataFrame([(*r, 1.5, 5) for r in [*rows, *BROKEN]], "vec_id bigint, embedding array<float>, label int, whitened double, n int")
    got = whitening.whiten(df.repartition(5)).collect()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in rows])
    n, s = len(x), x.sum(axis=0)
    cov = np.cov(x.T.astype(float), bias=True)
    values, axes = np.linalg.eigh(cov)
    plain = {}
    for j in range(8):
        e, axis = values[-1 - j], axes[:, -1 - j]
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        for (i, _, _), row in zip(rows, x, strict=True):
            plain.setdefault((i, j + 1), []).append((int(((n * row - s) ** 2).sum()), float((row - s / n) @ axis / np.sqrt(e)), e / np.trace(cov)))
    ours = defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        ours[r.vec_id, r.component].append((r.deviation, r.whitened, r.explained))
    assert set(ours) == set(plain)
    for key, want in plain.items():
        assert np.allclose(sorted(ours[key]), sorted(want), rtol=1e-9, atol=1e-9), key
        assert [w[0] for w in sorted(ours[key])] == [w[0] for w in sorted(want)]


def test_whitening_of_flat_and_huge_vectors(spark):
    flat = spark.createDataFrame([(i, [float(i % 3), 1.0, 2.0]) for i in range(9)], "vec_id bigint, embedding array<float>")
    assert {(r.component, r.explained) for r in whitening.whiten(flat).collect()} == {(1, 1.0)}
    assert whitening.whiten(flat.where("vec_id % 3 = 1")).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [3.0, 5.0])], "vec_id bigint, embedding array<double>")
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(huge).collect()} == {(0, None), (1, None), (2, 122_683_392)}
    assert whitening.deviations(np.array([[100_000, 5]]), 3, [300_001, 14]) == [2]
    assert whitening.deviations(np.array([[1 << 40, 5]]), 2, [(1 << 41) - 3, 10]) == [9]
