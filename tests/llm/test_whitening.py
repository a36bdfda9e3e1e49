import math

import numpy as np
import pytest

from opsloom.llm.symmetric_eigen import largest_values, leading, tridiagonal
from opsloom.llm.whitening import whitened

ROWS = "vec_id long, embedding array<float>, component string, n string, deviation string"


def matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 64, 150):
        a = rng.standard_normal((n + 5, n)) * np.geomspace(1, 30, n)
        yield a.T @ a
    yield np.diag([3.0, 3, 3, 2, 2, 1, 1, 1, 0, 0])
    yield np.ones((12, 12))
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    yield q @ np.diag([5.0] * 5 + [5 - 1e-9] * 4 + [1.0] * 11) @ q.T
    yield np.zeros((4, 4))
    yield 1e200 * np.diag([1.0, 2, 3]) + 1e-200


@pytest.mark.parametrize("place", range(11))
def test_eigenpairs(place):
    a = list(matrices())[place]
    n = min(8, len(a))
    values, vectors = leading(a, 8)
    size = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values / size, np.linalg.eigvalsh(a / size)[::-1][:n], atol=1e-12 * len(a))
    assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
    assert np.abs(a / size @ vectors - vectors * (values / size)).max() < 1e-12 * len(a)


def test_tridiagonal_keeps_eigenvalues():
    a = next(m for m in matrices() if len(m) == 64)
    diagonal, beside, mirrors = tridiagonal(a)
    t = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
    assert len(mirrors) == 62
    assert np.allclose(np.linalg.eigvalsh(t), np.linalg.eigvalsh(a))
    assert np.allclose(largest_values(diagonal, beside, 64), np.linalg.eigvalsh(a)[::-1], rtol=1e-9)


def brute(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    return x, s, (c @ axes) / np.sqrt(e), e / np.trace(v)


def test_whole_table(table):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 12)) * np.linspace(1, 4, 12)).astype(np.float32)
    vectors[7] = vectors[8] = vectors[9]
    rows = [(i, [float(x) for x in v], "a", "b", "c") for i, v in enumerate(vectors)]
    odd = [(900, None, "", "", ""), (901, [math.nan] * 12, "", "", ""), (902, [1.0] * 11 + [None], "", "", ""), (903, [math.inf] * 12, "", "", ""), (904, [], "", "", "")]
    rows += [(None, *rows[0][1:]), (3, *rows[3][1:])]
    vectors = np.concatenate([vectors, vectors[:1], vectors[3:4]])
    got = whitened(table(rows + odd, ROWS)).collect()
    x, s, white, share = brute(vectors)
    n = len(x)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(8):
        ours = np.array([by[r[0], k + 1].whitened for r in rows])
        assert min(np.abs(ours - white[:, k]).max(), np.abs(ours + white[:, k]).max()) < 1e-9
        assert abs(by[5, k + 1].explained - share[k]) < 1e-12
    for i, r in enumerate(rows):
        assert by[r[0], 1].deviation == sum((n * int(a) - int(b))**2 for a, b in zip(x[i], s))


def test_few_or_no_directions(table):
    def rows(*vectors):
        return whitened(table([(i, v, "", "", "") for i, v in enumerate(vectors)], ROWS)).collect()

    assert rows() == [] and rows([1.0, 2.0]) == [] and rows([1.0, 2.0], [1.0, 2.0]) == [] and rows(None, []) == []
    two = rows([0.0, 0.0, 5.0], [3.0, 4.0, 5.0])
    assert [(r.component, abs(round(r.whitened, 9))) for r in two] == [(1, 1.0), (1, 1.0)]
    assert two[0].explained == pytest.approx(1) and two[0].identity_error < 1e-9
    with pytest.raises(ValueError, match="widths"):
        rows([1.0], [1.0, 2.0])


def test_deviation_beyond_a_long(table):
    got = whitened(table([(i, [1e11 * i, 0.0], "", "", "") for i in range(3)], ROWS)).collect()
    assert {r.vec_id: r.deviation for r in got if r.vec_id != 1} == {0: None, 2: None}
