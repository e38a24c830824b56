import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weirmark.llm import best_fit, common, queries

DOCS = "doc_id long, text string, length string, part int"
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


@lru_cache(None)
def fewest(lengths, size):
    """Fewest bins, by trying all contents of the bin with the longest."""
    if not lengths:
        return 0
    found = set()

    def fill(rest, at, room):
        found.add(rest)
        for i in range(at, len(rest)):
            if rest[i] <= room and (i == at or rest[i] != rest[i - 1]):
                fill(rest[:i] + rest[i + 1 :], i, room - rest[i])

    fill(lengths[1:], 0, size - lengths[0])
    return 1 + min(fewest(x, size) for x in found)


def counted(lengths, size):
    return np.bincount(np.array(lengths, int), minlength=size + 1)


@settings(max_examples=400, deadline=None)
@given(st.integers(5, 30).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), min_size=1, max_size=9))))
def test_reduction_loses_no_optimum(case):
    size, lengths = case
    left = counted(lengths, size)
    fixed = best_fit.dominant_sets(left)
    rest = tuple(sorted((x for x in range(size + 1) for _ in range(left[x])), reverse=True))
    used = [x for own, times in fixed for _ in range(times) for x in own]
    assert all(sum(own) <= size and times > 0 for own, times in fixed)
    assert sorted([*used, *rest]) == sorted(lengths)
    assert sum(times for _, times in fixed) + fewest(rest, size) == fewest(tuple(sorted(lengths, reverse=True)), size)


def naive_best_fit(lengths, size):
    rooms = []
    for w in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= w]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else size) - w)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_equals_naive(lengths):
    found = best_fit.best_fit(counted(lengths, 40))
    assert sorted(x for content, n in found for x in [40 - sum(a * b for a, b in content)] * n) == naive_best_fit(lengths, 40)
    assert sorted(a for content, n in found for a, b in content for _ in range(b * n)) == sorted(lengths)


def checked(docs, found, size, end):
    """Every document's ids in pieces, and every sequence filled without gaps; how many sequences there are."""
    tok = Tokenizer.from_file(FILE)
    want = []
    for doc_id, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end]
        first = (len(ids) - 1) % size + 1
        for piece, b in enumerate(range(first, len(ids) + 1, size)):
            own = ids[0 if not piece else b - size : b]
            want.append((doc_id, piece, b - len(own), len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("block", [200, 4 << 20])
def test_pack(spark, monkeypatch, block):
    """Nulls, repeats, special strings, white space, a text of many pieces; blocks that forget their units."""
    monkeypatch.setattr(best_fit, "BLOCK_BYTES", block)
    monkeypatch.setattr(best_fit, "KEPT_UNITS", 50 if block == 200 else 1 << 18)
    texts = [None, "", " ", "  two  spaces ", "a\n b\t c ", "x<|endoftext|>y z", "Straße ÄÖ 北京 \x1c \x85 é", "word " * 300, "lang und länger " * 4000, "x" * 5000, "one two three", "Ġ Ġword wĠ"]
    docs = [*enumerate(texts), (None, "no id"), (None, "no id"), (3, "again"), (3, "again"), *((100 + i, "w " * (i % 37)) for i in range(200))]
    frame = spark.createDataFrame([(*d, "l", 0) for d in docs], DOCS).repartition(5)
    found = best_fit.best_fit_pack(frame, FILE, size=64, end=2)
    assert found.dtypes == [tuple(x.split(" ")) if "long" not in x else (x.split(" ")[0], "bigint") for x in best_fit.PLACED.split(", ")]
    n = checked(docs, found.collect(), 64, 2)
    total = sum(r.length for r in found.collect())
    assert n >= -(-total // 64)
    assert best_fit.best_fit_pack(frame.limit(0), FILE, size=64, end=2).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_best_fit(spark, sf).collect()
    n = checked(docs, found, 1024, 2)
    assert n <= 1.01 * -(-sum(r.length for r in found) // 1024)
