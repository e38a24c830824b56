import random

import numpy as np
import pyarrow as pa
import pytest

from weirmark.llm import common, similar, simhash


@pytest.mark.parametrize("rows", [1, 50, 10_000])
def test_whole_groups(rows):
    rng = random.Random(4)
    keys = sorted((rng.randrange(3), rng.randrange(4)) for _ in range(500)) + [(5, 5)] * 300 + [(5, 6)]
    table = pa.table({"a": pa.array([k[0] for k in keys], pa.int32()), "b": pa.array([k[1] for k in keys], pa.int64()), "n": list(range(len(keys)))})
    batches = [x for b in table.to_batches(37) for x in (b, b.slice(0, 0))]
    got = [t.to_pylist() for t in common.whole_groups(iter(batches), ("a", "b"), rows)]
    assert [r["n"] for t in got for r in t] == list(range(len(keys)))
    groups = [{(r["a"], r["b"]) for r in t} for t in got]
    assert sum(map(len, groups)) == len(set(keys))  # no group is in two tables
    largest = max(map(keys.count, set(keys)))
    assert max(map(len, got)) <= rows + 37 + largest
    assert list(common.whole_groups(iter([]), ("a",), rows)) == []


def flipped(rng, x, bits, n):
    return x ^ sum(1 << k for k in rng.sample(range(bits), n))


def brute(values, near):
    """The smallest place that near values reach, of each."""
    part = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if part[i] != part[j] and near(values[i], values[j]):
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    return part


@pytest.mark.parametrize("way", similar.DEALINGS)
@pytest.mark.parametrize("rows, tile", [(1 << 18, 16_384), (20, 4)])
def test_dealings(spark, monkeypatch, way, rows, tile):
    """Every way to deal finds the texts that meet by brute force, whatever a task holds at once."""
    monkeypatch.setattr(similar, "ROWS", rows)
    monkeypatch.setattr(similar, "TILE_LEAST", tile)
    rng = random.Random(9)
    base = [rng.getrandbits(256) for _ in range(25)]
    values = [flipped(rng, b, 256, rng.randrange(20, 45)) for b in base for _ in range(6)] + base[:5] * 2

    def near(x, y):
        d = x ^ y
        return d.bit_count() <= similar.SKETCH_BUDGET and any((d >> 32 * w & 0xFFFFFFFF).bit_count() <= similar.WORD_BUDGET for w in range(similar.WORDS))

    part = brute(values, near)
    assert 10 < len(set(part)) < len(values) - 10
    sketches = [(i, np.array([v >> 64 * k & (1 << 64) - 1 for k in range(4)], np.uint64).view(np.int64).tolist()) for i, v in enumerate(values)]
    with common.Scratch() as made:
        got = dict(similar.candidate_groups(spark.createDataFrame(sketches, "rid long, sketch array<long>"), made, way).collect())
    assert [got.get(i, i) for i in range(len(values))] == part


def test_dealing_by_size():
    """Longer paths only where short ones would be copied to more tiles; a text is then copied at most 20 times a word up to 10^10 texts."""
    ways = [similar.dealing(n, similar.TILE_MOST) for n in (0, 10**5, 10**7, 10**9, 10**10)]
    assert ways[:3] == [(4, 1)] * 3 and ways[3] != (4, 1) and ways[4] == (6, 3)


def test_simhash_in_few_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS", 10)
    monkeypatch.setattr(simhash, "TILE_LEAST", 8)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(10)]
    values = list({flipped(rng, b, 64, rng.randrange(4)) for b in base for _ in range(12)})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    # A forest's links join the same values as all links do.
    at = {x: i for i, x in enumerate(signed)}
    joined = {(at[r.fp], at[r.root]) for r in links}
    assert all((values[i] ^ values[j]).bit_count() <= 16 for i, j in joined)
    part = list(range(len(values)))
    for i, j in joined:
        part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    assert part == brute(values, lambda x, y: (x ^ y).bit_count() <= 2)


def test_nothing_is_left_behind(spark, monkeypatch):
    """Of the intermediate tables only the result stays."""
    made = []
    whole = common.scratch_path
    monkeypatch.setattr(common, "scratch_path", lambda s, name: made.append(whole(s, name)) or made[-1])
    docs = spark.createDataFrame([(i, f"text number {i % 7} of these few") for i in range(40)], "doc_id long, text string")
    simhash.simhash_components(docs).count()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    left = [p for p in made if path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(p))]
    assert len(made) > 5 and len(left) == 1 and "classified" in left[0]
