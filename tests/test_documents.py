import json
import random

import pytest

from weirmark.sources import documents, readers

SCHEMA = "city string, station string, window array<string>, more struct<a:struct<b:array<int>>>, markets array<struct<slug:string,n:bigint,points:array<struct<t:bigint,p:double>>>>"


@pytest.fixture
def small_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(kept, (n, 0), strict=True)]
    for k, v in kept.items():
        spark.conf.set(k, v)


def nasty(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "北", " ", "\n", "x", ":"]) for _ in range(rng.randrange(12)))


def made(seed, n):
    rng = random.Random(seed)
    markets = [{"slug": nasty(rng), "n": i, "points": [{"t": j, "p": j / 4} for j in range(rng.randrange(4))]} for i in range(n)]
    return {"city": nasty(rng), "window": ["2026-03-01", nasty(rng) + "}, x"], "more": {"a": {"b": [1, 2]}, "c": [{"d": 1}]}, "markets": markets, "others": [{"slug": "no market", "x": {"y": [{}]}}], "station": nasty(rng)}


def pairs(df):
    """Rows of (document, market), from either reader."""
    return sorted(map(str, df.selectExpr("city", "station", "window", "more", "explode_outer(markets) market").collect()))


@pytest.mark.parametrize("size, indent, buffer", [(90, None, 1 << 20), (130, 1, 60), (1000, None, 300), (1 << 20, 2, 1 << 20)])
def test_ranges_give_what_whole_files_give(spark, tmp_path, small_ranges, monkeypatch, size, indent, buffer):
    monkeypatch.setattr(documents, "BUFFER", buffer)
    docs = [made(1, 30), made(2, 1), made(3, 0), {"city": "no arrays", "station": None}, {"markets": None, "city": "x"}, {}, {"markets": [], "city": "{"}, {"window": ["a}", ", b"], "markets": [{"slug": None}, {}]}]
    for i, doc in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=i % 2 == 0) + "\n" * (i % 3))
    small_ranges(size)
    got = documents.read_records(spark, str(tmp_path), SCHEMA, "markets")
    want = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    assert pairs(got) == pairs(want)
    assert got.where(f"{documents.CORRUPT} is not null").count() == 0


def test_corrupt_documents(spark, tmp_path, small_ranges):
    good = json.dumps(made(4, 5))
    for name, text in (("good", good), ("cut", good[:-1]), ("half", good[: len(good) // 2]), ("empty", ""), ("list", f"[{good}]"), ("none", "nothing"), ("odd", '{"city": "c", "markets": [{"slug": "s", "n": "no number"}]}')):
        (tmp_path / f"{name}.json").write_text(text)
    small_ranges(50)
    got = documents.read_records(spark, str(tmp_path), SCHEMA, "markets").collect()
    bad = {r[documents.CORRUPT].rpartition("/")[2] for r in got if r[documents.CORRUPT] and r.markets is None}
    assert bad == {"cut.json", "half.json", "list.json", "none.json"}  # an empty file has no row, as with any reader of lines
    assert sum(r[documents.CORRUPT] is None for r in got) == 5 and [r[documents.CORRUPT][:11] for r in got if r.city == "c"] == ['{"slug": "s']


def test_a_large_document_is_many_tasks(spark, tmp_path, small_ranges):
    path = tmp_path / "large_history.json"
    with path.open("w") as f:
        f.write('{"city": "Munich", "markets": [')
        for i in range(3000):
            f.write(("," if i else "") + json.dumps({"date": "2026-03-01", "slug": f"s{i}", "buckets": [{"bucket": "2°C", "history": [{"t": t, "p": t / 8} for t in range(40)]}]}))
        f.write("]}")
    small_ranges(1 << 18)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() >= 10
    def counts(df):
        points = df.selectExpr("city", "explode(markets) m").selectExpr("city", "m.slug slug", "explode(m.buckets) b").selectExpr("city", "slug", "inline(b.history)")
        return points.groupBy("city").agg({"slug": "count", "t": "sum", "p": "sum"}).collect()

    assert counts(readers.read_large_history(spark, str(path))) == counts(readers.read_market_history(spark, str(path)))
