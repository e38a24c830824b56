import hashlib

import numpy as np
import pytest

from weirmark.llm import bit_planes, common

VECTORS = "embedding array<float>, vec_id long, cluster string, x int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def brute(rows, k, rounds, scale, seed):
    kept = [(i, np.array([int(np.floor(scale * float(np.float32(c)))) for c in v], object)) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()), list(r[1])))
    centres = [x for _, x in order[:k]]

    def assign():
        return [min((int(((x - c) ** 2).sum()), n) for n, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            own = [x for (_, x), (_, m) in zip(kept, near, strict=True) if m == n]
            if own:
                centres[n] = sum(own) // len(own)
    near = assign()
    sums = [sum(d for d, m in near if m == n) for n in range(len(centres))]
    return sorted(((i, m, d, sums[m], sum(sums), hashlib.sha256(",".join(map(str, centres[m])).encode()).hexdigest()) for (i, _), (d, m) in zip(kept, near, strict=True)), key=str)


def got(spark, rows, **more):
    found = bit_planes.bit_plane_clusters(spark.createDataFrame([(v, i, "c", 0) for i, v in rows], VECTORS), **more)
    return sorted(map(tuple, found.collect()), key=str)


def test_products_of_planes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**20), 2**20, (50, 64)), rng.integers(-(2**20), 2**20, (5, 64))
    a[0], b[0] = -(2**20), 2**20 - 1
    words = bit_planes.to_planes(a, 21)
    assert (bit_planes.products(words, bit_planes.to_planes(b, 21)) == a @ b.T).all()
    assert (bit_planes.squares(words) == (a * a).sum(axis=1)).all()
    assert (bit_planes.component_sums(words) == a.sum(axis=0)).all()
    one = np.zeros((1, 64), np.int64)
    assert (bit_planes.products(bit_planes.to_planes(one, 1), bit_planes.to_planes(one - 1, 1)) == 0).all()


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_clusters(spark, rounds):
    """Ties, repeated rows and ids, null ids, short, null and non-finite vectors, negative and large components."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 64))
    rows = [(i, [float(x) for x in centre[i % 4] + rng.normal(size=64) / 3]) for i in range(80)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, rows[4][1]), (200, [0.0] * 64), (201, [-50.0] * 64), (202, [1.0] * 63), (203, [1.0] * 65), (204, None), (205, [None] + [1.0] * 63), (206, [float("nan")] + [1.0] * 63), (207, [float("inf")] + [1.0] * 63), (208, [])]
    want = dict(k=5, rounds=rounds, scale=16.0, seed="3")
    assert got(spark, rows, **want) == brute(rows, **want)


def test_few_and_no_vectors(spark):
    want = dict(k=8, rounds=3, scale=1024.0, seed="3")
    for rows in ([], [(1, None)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(5)]):
        assert got(spark, rows, **want) == brute(rows, **want)
    with pytest.raises(ValueError, match="too large"):
        got(spark, [(1, [1e9] * 64), (2, [-1e30] * 64)], **want)

