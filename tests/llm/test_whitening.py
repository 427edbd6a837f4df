import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import whitening
from pairloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def spectrum(kind, d, rng):
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {"plain": rng.random(d), "repeated": np.repeat([3.0, 1.0], d)[:d], "low": np.r_[rng.random(max(d // 3, 1)), np.zeros(d)][:d],
              "graded": 10.0 ** -np.linspace(0, 14, d), "alike": np.full(d, 5.0), "zero": np.zeros(d), "signed": rng.standard_normal(d)}[kind]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64])
@pytest.mark.parametrize("kind", ["plain", "repeated", "low", "graded", "alike", "zero", "signed"])
def test_divide_equals_the_eigenvalues(kind, d):
    a = spectrum(kind, d, np.random.default_rng(d))
    a = (a + a.T) / 2
    values, vectors = whitening.divide(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 8), st.integers(0, 10 ** 6))
def test_polar_factor_is_the_sign(d, seed):
    a = spectrum("signed", d, np.random.default_rng(seed))
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    if np.abs(values).min() > 1e-6:
        assert np.abs(whitening.polar((a + a.T) / 2) - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-8


def brute(rows, components=4):
    """By id: (n, deviation, explained, whitened up to sign), with numpy's eigenvectors and Python's integers."""
    clean = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = sorted({tuple(x) for _, x in clean})
    n, d = len(xs), len(xs[0])
    sums = [sum(x[j] for x in xs) for j in range(d)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in xs])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in clean:
        off = [n * v - s for v, s in zip(x, sums)]
        white = np.array([o / n for o in off]) @ vectors / np.sqrt(values)
        out.setdefault(i, []).append((n, sum(o * o for o in off), values / np.trace(cov), white))
    return out


def compare(got, want):
    signs = {}
    seen = {}
    for r in got:
        seen.setdefault(r["vec_id"], []).append(r)
    assert set(seen) == set(want)
    for key, rows in seen.items():
        n, deviation, explained, white = want[key][0]
        assert len(rows) == len(white) * len(want[key])
        for r in rows:
            j = r["component"] - 1
            assert (r["n"], int(r["deviation"])) == (n, deviation)
            assert abs(r["explained"] / explained[j] - 1) < 1e-9 and r["identity_error"] < 1e-9
            assert abs(abs(r["whitened"]) - abs(white[j])) < 1e-8
            if abs(white[j]) > 1e-6:
                assert signs.setdefault(j, np.sign(r["whitened"] * white[j])) == np.sign(r["whitened"] * white[j])


def test_whiten_equals_brute_force(table):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 1] + 40).tolist(), i % 2) for i in range(200)]
    rows += [(1000 + i, rows[7][1], None) for i in range(50)]  # copies count once
    bad = [(1, None, 1), (2, [], 1), (3, [None] * 6, 1), (4, [float("nan")] * 6, 1), (5, [float("inf")] + [0.0] * 5, 1), (6, [1.0] * 5, 1)]
    df = table(rows + [(2000 + i, v, l) for i, v, l in bad], SCHEMA)
    compare(whitening.whiten(df).collect(), brute([(i, [float(np.float32(c)) for c in v]) for i, v, _ in rows]))


def test_edges(table):
    empty = table([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(table([(1, None, 1)], SCHEMA)).count() == 0
    assert whitening.whiten(table([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)).count() == 0  # no spread, no component
    line = whitening.whiten(table([(None, [float(i), 2.0 * i], 1) for i in range(5)], SCHEMA)).collect()
    assert [r["component"] for r in line] == [1] * 5 and {r["vec_id"] for r in line} == {None}
    assert all(abs(r["explained"] - 1) < 1e-12 for r in line)


def test_deviations_beyond_a_long_are_exact(table):
    rows = [(i, [2.0 ** 40 * i, float(-i)], 1) for i in range(5)]
    want = brute([(i, v) for i, v, _ in rows], 1)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(table(rows, "vec_id long, embedding array<double>, label int"), components=1).collect()}
    assert got == {k: v[0][1] for k, v in want.items()}


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op12_whitening"](spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["n"] == "bigint"
    compare(got.collect(), brute(rows))
