"""Whitening against numpy's eigenvalues, and exact integers against Python's."""

import numpy as np
import pytest

from barloom.llm.whitening import count_above, leading, tridiagonal, whiten

RNG = np.random.default_rng(7)


def symmetric(values):
    q, _ = np.linalg.qr(RNG.standard_normal((len(values), len(values))))
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


MATRICES = {
    "scaled": lambda: (lambda a: a.T @ a)(RNG.standard_normal((120, 40)) * RNG.uniform(0.01, 20, 40)),
    "one": lambda: np.array([[3.0]]),
    "two": lambda: np.array([[2.0, 1.0], [1.0, 2.0]]),
    "diagonal": lambda: np.diag(np.arange(30.0)),
    "multiple": lambda: symmetric(np.repeat([5.0, 3.0, 1e-9], 12)),
    "close": lambda: symmetric(np.concatenate([[1, 1 + 1e-13, 1 - 1e-10, 1 - 1e-7], np.linspace(0, 0.9, 30)])),
    "rank": lambda: (lambda a: a.T @ a)(RNG.standard_normal((5, 25))),
    "zero": lambda: np.zeros((6, 6)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_leading(name):
    m = MATRICES[name]()
    n = len(m)
    values, vectors = leading(m, 32)
    want = np.linalg.eigvalsh(m)[::-1][:32]
    scale = max(np.abs(m).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-12 * scale * n
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(m @ vectors - vectors * values).max() <= 1e-12 * scale * n
    diagonal, off = tridiagonal(m)
    shifts = np.concatenate([(want[1:] + want[:-1]) / 2, [want[0] + scale]])
    apart = np.abs(shifts[:, None] - np.linalg.eigvalsh(m)).min(1) > 1e-9 * scale
    counts = (np.linalg.eigvalsh(m) > shifts[apart][:, None]).sum(1)
    assert count_above(diagonal, off, shifts[apart]).tolist() == counts.tolist()


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string, x int, line string")


def test_whiten(spark):
    dims, rows = 40, []
    vectors = RNG.standard_normal((300, dims)).astype(np.float32) * RNG.uniform(0.05, 3, dims).astype(np.float32) + 2
    for i, v in enumerate(vectors.tolist()):
        rows.append((i, v))
    rows += [(7, rows[7][1]), (None, rows[9][1])]  # a repeated row and a null id stay
    odd = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]]), (903, [float("inf"), *rows[0][1][1:]]), (904, []), (905, [1.0, 2.0])]
    got = whiten(table(spark, [(*r, None, None, None, None) for r in rows + odd])).toPandas()
    assert len(got) == 32 * len(rows)
    x = np.floor(64 * np.array([r[1] for r in rows], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    assert (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    d = x - s / n
    values, axes = np.linalg.eigh(np.cov((x - 1_000_000).T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = d @ axes[:, :32] / np.sqrt(values[:32])
    one = {r.vec_id: r for r in got[got.component == 1].itertuples() if r.vec_id == r.vec_id}
    for i in range(300):
        assert one[i].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
    for k in range(32):
        part = got[(got.component == k + 1) & got.vec_id.notna()].drop_duplicates("vec_id").set_index("vec_id")
        found = part.whitened.loc[list(range(300))].to_numpy()
        sign = np.sign(found @ want[:300, k])
        assert np.abs(found * sign - want[:300, k]).max() < 1e-6
        assert abs(part.explained.iloc[0] / (values[k] / values.sum()) - 1) < 1e-9


def test_few_directions(spark):
    """No component without variance; nothing from no rows or from equal rows."""
    plane = [(i, [float(a), float(a), float(b)], None, None, None, None) for i, (a, b) in enumerate(RNG.standard_normal((50, 2)))]
    got = whiten(table(spark, plane)).toPandas()
    assert sorted(got.component.unique()) == [1, 2] and got.identity_error[0] < 1e-9
    for rows in ([], [(1, None, None, None, None, None)], [(i, [1.0, 2.0], None, None, None, None) for i in range(5)]):
        assert whiten(table(spark, rows)).count() == 0


def test_large_entries(spark):
    """Deviations beyond 64-bit products are exact, and null where no long holds them."""
    rows = [(i, [float(v), 1.0], None, None, None, None) for i, v in enumerate((0, 2**20, 2**21, 2**45))]
    got = whiten(table(spark, rows)).toPandas()
    x = np.array([[64 * int(r[1][0]) + 1_000_000, 1_000_064] for r in rows], object)
    s = x.sum(0)
    for i in range(4):
        exact = sum((4 * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
        value = got[(got.vec_id == i) & (got.component == 1)].deviation.iloc[0]
        assert (value != value or value is None) if exact >= 2**63 else value == exact
