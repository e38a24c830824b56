import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weirmark.llm import common, prefix_trie

TALKS = "conv_id long, turn long, role string, text string, depth string, pos int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def brute(rows, group=5, most=9):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append(((turn is not None, turn or 0), role or "", text or ""))
    talks = {c: [r[1:] for r in sorted(own)] for c, own in talks.items()}
    whole = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = talks.get(c - int(math.fmod(c, group)), [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            nodes[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    sums = {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        sums[k] = (sum(sums[x][0] for x in children[k]) or 1, own + sum(sums[x][1] for x in children[k]))
    ends = {k: ",".join(str(c) for c in own if len(whole[c]) == len(k)) for k, own in nodes.items()}
    return sorted(((own[0], len(k), nodes[k[:-1]][0] if k else None, len(own), len(children[k]), *sums[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, own in nodes.items()), key=str)


def got(spark, rows, **more):
    found = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "d", 0) for r in rows], TALKS), 5, 9, **more)
    return sorted(map(tuple, found.collect()), key=str)


def made(seed, convs=60):
    random.seed(seed)
    rows = []
    for c in random.sample(range(-40, 200), convs):
        for turn in range(random.choice([1, 2, 5, 9, 12])):
            rows.append((c, random.choice([turn, turn, None, 0]), random.choice(["user", "bot", None]), random.choice(["a", "b", "é", "", None])))
    return rows + rows[:5] + [(None, 1, "user", "x"), (7, None, None, None)]


@pytest.mark.parametrize("task", [3, 40, 1 << 15])
def test_trie(spark, monkeypatch, task):
    """Ties, repeats, nulls, negative ids; small tasks make many levels of segments, small chunks and spans cut all sums."""
    for name, size in (("CHUNK", 3), ("SPAN", 16), ("IDS", 2)):
        monkeypatch.setattr(prefix_trie, name, size)
    rows = made(task)
    assert got(spark, rows, task=task) == brute(rows)


def test_edge_rows(spark):
    turnless = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    for rows in ([], [(None, 1, "a", "b")], [(3, 0, "user", "x")], [(turnless, 0, "user", "x")], [(c, 0, "user", "same") for c in range(300)], [(10, t, "user", f"turn {t}" * 50) for t in range(200)], [(4, None, "user", "x" * 300_000)] * 3):
        assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("task", [2, 7, 1000])
def test_positions_of_a_shuffled_list(spark, task):
    """A list whose neighbours have unrelated names hardly shrinks by dealing, so that segments have to absorb each other."""
    random.seed(task)
    names = [(random.randrange(10**9), random.randrange(10)) for _ in range(150)]
    weights = [random.randrange(5) for _ in names]
    rows = [(*a, *b, w) for a, b, w in zip(names, [*names[1:], (0, -1)], weights, strict=True)]
    random.shuffle(rows)
    with common.Scratch() as keep:
        found = prefix_trie.list_positions(keep, keep(spark.createDataFrame(rows, "conv long, slot long, next_conv long, next_slot long, weight long"), "list"), task).collect()
    assert {(r.conv, r.slot): r.pos for r in found} == {a: sum(weights[:i]) for i, a in enumerate(names)}


def test_prefixes_that_meet_by_chance_are_refused(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    with pytest.raises(Exception, match="met by chance"):
        got(spark, [(5, 0, "user", "a"), (10, 0, "user", "b")])
