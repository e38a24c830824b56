import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirmark.llm import bpe, common, exact_dedup, knn_join, language_id, packing, quality, queries, similar, simhash, suffix_dedup, token_counts, toxicity

DOCS = "doc_id long, text string, hash string, rid long"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def made(seed, n=60):
    random.seed(seed)
    parts = ["".join(random.choice("ab ") for _ in range(random.choice([199, 200, 201, 400]))) for _ in range(5)] + ["A" * 450, "Straße ÄÖ", ""]
    rows = [(i, "".join(random.choice([*parts, "".join(random.choice("abcdefgh é") for _ in range(random.choice([3, 300])))]) for _ in range(random.randrange(0, 4)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "x"), (n + 2, "word"), (n + 2, "word"), (n + 3, "lang " * 5000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", 0) for r in rows], DOCS)


def brute_repeats(rows, w=200):
    seen = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for i, b in enumerate(texts):
        for s in range(len(b) - w + 1):
            seen[b[s : s + w]].append((i, s))
    cover = [np.zeros(len(b), bool) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s : s + w] = True
    out = []
    for (d, _), b, c in zip(rows, texts, cover, strict=True):
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        out.append((d, len(b), int(c.sum()), int((np.diff(np.concatenate(([0], c.astype(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("repeat_ids, bits, piece", [(False, 64, 1 << 18), (True, 64, 700), (False, 5, 1 << 18), (True, 9, 900)])
def test_suffix_dedup(spark, repeat_ids, bits, piece):
    """Hashes of few bits meet by chance all the time, small pieces cut most texts: the result is the same."""
    rows = [r for r in made(3, 60 if bits == 64 else 20) if repeat_ids or r[0] not in (None, 62, 22)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), bits=bits, piece=piece).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)


def periodic(seed):
    """Texts of short and long periods, broken in places, some of them parts of others."""
    random.seed(seed)
    bases = ["x", "ab", "abcdefg", "".join(random.choice("abcdefgh") for _ in range(230)), "".join(random.choice("ab") for _ in range(410))]
    texts = []
    for base in bases:
        whole = base * (2600 // len(base))
        texts += [whole, whole[: 199 + len(base)], whole[3:203], whole[:700] + "|" + whole[5:900], "".join(random.choice("abcdefgh") for _ in range(150)) + whole[:450] + "".join(random.choice("abcdefgh") for _ in range(150))]
    return list(enumerate(random.sample(texts, 18)))


@pytest.mark.parametrize("bits, piece", [(64, 1 << 18), (64, 700), (6, 900)])
def test_suffix_dedup_of_periodic_texts(spark, bits, piece):
    rows = periodic(bits + piece)
    got = suffix_dedup.suffix_dedup(frame(spark, rows), bits=bits, piece=piece).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)


def test_long_periodic_texts_leave_few_anchors():
    for base in (b"x", b"abcdefg", bytes(random.Random(1).choices(b"abcdefgh", k=400))):
        text = base * (2_000_000 // len(base))
        batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text], pa.binary())], names=["rid", "text"])
        assert sum(r.num_rows for r in suffix_dedup._anchor_rows(200, 40, 64, suffix_dedup.BUFFER)(iter([batch]))) < 100


def test_remove_repeats(spark):
    rng = random.Random(1)
    tails = ["".join(rng.choice("vwxyz") for _ in range(150)) for _ in range(2)]
    rows = [*made(3, 20), (70, "a" + "é" * 150 + "ä" + tails[0]), (71, "b" + "é" * 150 + "ö" + tails[1])]  # the shared run ends inside a character
    left = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert len(left) == len({r[0] for r in rows}) and not any("\ufffd" in (t or "") for t in left.values())
    assert left[70] == "aä" + tails[0] and left[71] == "bö" + tails[1]
    assert left[20] is None and suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0
    assert suffix_dedup.suffix_dedup(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = made(4)
    got = exact_dedup.exact_dedup(frame(spark, rows), keep=keep).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[hashlib.sha256((t or "").encode().lower()).hexdigest()].append(d)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    for r in got:
        ids = [d for d in groups[r.text_sha256] if d is not None]
        assert r.keep_id == ((min if keep == "smallest" else max)(ids) if ids else None) and r.group_size == len(groups[r.text_sha256])
    assert exact_dedup.drop_exact_duplicates(frame(spark, rows), keep=keep).count() == len(groups)
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(fps))]


def test_simhash(spark, monkeypatch):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << k for k in random.sample(range(64), random.randrange(5))) for b in base for _ in range(30)})
    for tile in (10_000, 16):  # the second deals large subtries as tiles
        monkeypatch.setattr(simhash, "TILE_LEAST", tile)
        signed = np.array(fps, np.uint64).view(np.int64).tolist()
        links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
        from weirmark.llm.components import components

        root = {r.node: r.root for r in components(links.select(F.col("fp").alias("u"), F.col("root").alias("v"))).collect()}
        assert [root.get(x, x) for x in signed] == [int(np.array([v], np.int64)[0]) for v in brute_components([x & (2**64 - 1) for x in signed], signed)]
    rows = made(6)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(frame(spark, rows)).collect()}
    prints = [simhash.fingerprint(t) for _, t in rows]
    assert got == {(d, f"{p:016x}"): c for (d, _), p, c in zip(rows, prints, brute_components(prints, [d for d, _ in rows]), strict=True)}
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0
    assert simhash.simhash_components(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b = "one two three four five six seven eight", "quite another text about nothing of the kind at all"
    left = lambda rows: sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()), key=str)
    assert left([(None, a), (None, b)]) == [(None, a), (None, b)]
    assert left([(None, a), (None, a), (None, b)]) == [(None, a), (None, b)]
    assert left([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert left([(5, a), (5, a), (5, b), (None, b)]) == [(5, a), (5, b)]
    got = left([(5, "x y z"), (5, "X y z"), (4, None), (4, ""), (6, " ")])
    assert len(got) == 2 and got[0] in [(4, None), (4, "")] and got[1] in [(5, "x y z"), (5, "X y z")]


def edited_copies():
    """Rows (id, text): random texts with copies of which 0 to 12 of 100 words are others, and one large group."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for copies in (*[4] * 15, 60):
        base = [word() for _ in range(100)]
        for _ in range(copies):
            own = list(base)
            for i in rng.sample(range(100), rng.randrange(5)) if copies == 60 else range(a := rng.randrange(90), a + rng.randrange(13)):
                own[i % 100] = word()
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [*enumerate(rows), (1000, "few words"), (1001, "Few  words"), (1002, None), (1003, " ")]


def brute_similar(rows):
    """Component of each row by all pairs of 5-word Jaccard similarity 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").encode().lower().split() for _, t in rows)]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    return part


@pytest.mark.parametrize("small, tile, group_tile", [(32, 16_384, 1024), (3, 16, 16)])  # the second deals large subtries and groups as tiles
def test_similar(spark, monkeypatch, small, tile, group_tile):
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "TILE_LEAST", tile)
    monkeypatch.setattr(similar, "GROUP_TILE", group_tile)
    rows = edited_copies()
    least = {}
    for (d, _), p in zip(rows, brute_similar(rows), strict=True):
        least[p] = min(d, least.get(p, d))
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), SF).collect()}
    # Whatever is left out is similar; of what is similar, nearly all is left out.
    assert got >= set(least.values()) and 16 < len(least) < len(rows) - 16
    assert len(got) - len(least) <= 0.1 * (len(rows) - len(least))
    # Null and repeated ids: texts are told apart.
    a, b = rows[0][1], "quite another text about nothing of the kind at all"
    left = lambda rows: sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), SF).collect()), key=str)
    assert left([(None, a), (None, b), (None, b)]) == sorted([(None, a), (None, b)], key=str)
    assert left([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert len(left([(None, None), (7, ""), (7, " "), (8, None)])) == 1
    assert corpus_pipeline.near_dedup(spark, frame(spark, rows).limit(0), SF).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank string, score string")


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 8).round(2).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 500)]
    rows += [(i % 60, rng.normal(0, 0.3, 8).tolist()) for i in range(60)] + [(50, rows[50][1]), (50, rows[50][1])]  # repeated ids, some with the same vector
    rows += [(i, rng.normal(0, 0.2, 3).tolist()) for i in range(700, 760)] + [(800, [1.0])]
    bad = [(500, None), (550, [float("nan")] + [0.0] * 7), (600, [None] + [0.0] * 7), (650, []), (None, [0.1] * 8), (850, [float("inf")] * 8)]
    v = [np.floor(256 * np.array(x)).astype(int) for _, x in rows]
    want = []
    for q, (i, _) in enumerate(rows):
        if i % 50 == 0:
            found = sorted(((-int(v[q] @ v[c]), j) for c, (j, _) in enumerate(rows) if c != q and len(v[c]) == len(v[q])))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    df = vectors(spark, [(*r, 0, "x", "y") for r in rows + bad])
    for pivots in (None, 8):
        assert sorted(tuple(r) for r in knn_join.top_k(df, F.col("vec_id") % 50 == 0, pivots=pivots).collect()) == sorted(want)
    assert knn_join.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert knn_join.top_k(df.where("vec_id >= 800"), F.col("vec_id") % 50 == 0).count() == 0
    big = vectors(spark, [(i, [1e6 + i, 3.0], 0, "", "") for i in range(9)])  # beyond what a double holds exactly
    scores = {r.vec_id: r.score for r in knn_join.top_k(big, F.col("vec_id") == 0).collect()}
    assert scores == {i: (256 * 10**6) * (256 * (10**6 + i)) + 768**2 for i in (8, 7, 6, 5, 4)}
    with pytest.raises(ValueError, match="64 bits"):
        knn_join.top_k(vectors(spark, [(0, [2e7, 1.0], 0, "", ""), (1, [1e300, 1.0], 0, "", "")]), F.col("vec_id") == 0)


def test_top_k_in_blocks(spark, monkeypatch):
    """Many small rings in one tile, one large ring in blocks, and several blocks of queries; a query is sent once to each tile."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.3, (1400, 16)), np.tile(rng.normal(0, 0.3, 16), (600, 1))]).round(3)
    v = np.floor(256 * x).astype(int)
    for name, value in (("LEAST_ROWS", 100), ("BLOCKS", 20), ("QUERY_LONGS", 16 * 150), ("PIVOT_ROWS", 20), ("ROUTE_CELLS", 5000)):
        monkeypatch.setattr(knn_join, name, value)
    sent, keep = [], common.Scratch.__call__

    def kept(self, df, name):
        found = keep(self, df, name)
        if name == "routes":
            sent.extend(found.select("query", "tile", F.size("places")).collect())
        return found

    monkeypatch.setattr(common.Scratch, "__call__", kept)
    got = knn_join.top_k(vectors(spark, [(i, r.tolist(), 0, "", "") for i, r in enumerate(x)]), F.col("vec_id") % 5 == 0).collect()
    want = []
    for q in range(0, 2000, 5):
        score = v @ v[q]
        order = [i for i in np.lexsort((np.arange(2000), -score)) if i != q][:5]
        want += [(q, n, int(i), int(score[i])) for n, i in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == want
    assert len({r[:2] for r in sent}) == len(sent)
    assert max(r[2] for r in sent) > 1
    assert len({r[1] for r in sent}) < 45


def test_routes_in_slices(monkeypatch):
    """However few queries are routed at a time, the routes are the same."""
    rng = np.random.default_rng(3)
    v = rng.integers(-200, 200, (60, 4))
    pivots = knn_join.Pivots(v[:20].tolist(), {4: 20})
    found = [{"cell": c, "ring": g, "n": int(rng.integers(1, 40)), "outer": float(rng.uniform(10, 90)), "norm": 400.0} for c in range(20) for g in range(3)]
    rings = {4: knn_join.Rings(found, 0, 0, 50)}
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(60)), pa.array(np.arange(60)), pa.array(v.tolist())], names=["rid", "vec_id", "v"])
    made = []
    for cells in (1 << 20, 120, 1):
        monkeypatch.setattr(knn_join, "ROUTE_CELLS", cells)
        made.append(pa.Table.from_batches(knn_join._routes(pivots, rings, 5)(iter([batch]))).to_pylist())
    assert made[0] == made[1] == made[2]
    per_tile = defaultdict(int)
    for f, t in zip(found, rings[4].tile.tolist(), strict=True):
        per_tile[t] += f["n"]
    assert max(per_tile.values()) <= 50


def test_tokens_and_bpe(spark, tmp_path):
    import tiktoken
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    rows = made(7, 20) + [(900, "a  b   c <|endoftext|> \n x\x1c y 　 z  "), (901, "it's 12 %%% naïve 日本語 " * 50), (902, "zz" * 3000)]
    df = frame(spark, rows)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for _ in range(2):  # the second run finds all counts in the cache
        got = token_counts.token_counts(df, P.path("byte_bpe_50k.json"), str(tmp_path / "cache")).collect()
        assert sorted(map(tuple, got), key=str) == sorted(((d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for d, t in rows), key=str)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == len({t or "" for _, t in rows})
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(open(path, "rb").read())
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.bpe_encode(df, path, P.PATTERN)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == sorted((str(d), encoding.encode_ordinary(t or "")) for d, t in rows)
    assert sorted(bytes(r.decoded) for r in bpe.bpe_decode(encoded, path).collect()) == sorted((t or "").encode() for _, t in rows)


def brute_padding(lengths, counts, buckets):
    from itertools import combinations

    ends = combinations(range(len(lengths) - 1), min(buckets, len(lengths)) - 1)
    return min(sum(n * (min(b for b in (*(lengths[i] for i in e), lengths[-1]) if b >= x) - x) for x, n in zip(lengths, counts, strict=True)) for e in ends)


def test_packing(spark):
    for sizes in ([0, 1, 1, 2, 5, 5, 9, 10, 11, 40, 41, 300, None, -3, 5000] * 30, [1030, 1040, 1046, 2000, 2001, 2500, 70_000] * 5, [7] * 9):
        lengths = [(i if i % 9 else None if i % 2 else 9, n, f"t{i}", "x") for i, n in enumerate(sizes)]
        got = packing.pack(spark.createDataFrame(lengths, "doc_id long, n_tokens long, text string, bucket string"), buckets=4, token_budget=400, keep=("text",)).toPandas()
        assert sorted(got.text) == sorted(x[2] for x in lengths) and (got.padding >= 0).all()
        assert {r.text: r.n_tokens for r in got.itertuples()} == {t: max(0, n or 0) for _, n, t, _ in lengths}
        batches = got.groupby("batch_id").agg(n=("slot", "size"), most=("slot", "max"), b=("boundary", "first"))
        assert ((batches.n * batches.b <= 400) | (batches.n == 1) | (batches.b == 0)).all() and (batches.most + 1 == batches.n).all()
        kinds = sorted({max(0, n or 0) for n in sizes})
        assert got.padding.sum() == brute_padding(kinds, [sum(max(0, n or 0) == k for n in sizes) for k in kinds], 4)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_bucket_boundaries():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths, k = np.sort(rng.choice(3000, rng.integers(1, 11), replace=False)), int(rng.integers(1, 7))
        counts = rng.integers(1, 9, len(lengths)) * (1 if k % 2 else 10**17)  # the second needs more than 64 bits
        ends = np.array(packing.bucket_boundaries(lengths, counts, k))
        padding = sum(int(c) * int(ends[np.searchsorted(ends, x)] - x) for x, c in zip(lengths, counts, strict=True))
        assert len(ends) <= k and padding == brute_padding(lengths.tolist(), counts.tolist(), k)


def test_held_out_accuracy(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    lang = queries.op2_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    assert (lang.lang_pred == lang.lang)[lang.held_out].mean() > 0.95
    found = queries.op6_quality(spark, SF).toPandas().merge(labels, on="doc_id")
    assert (found.predicted == found.quality)[found.held_out].mean() > 0.95
    more = SF.replace("0.01", "0.1")  # SF has six toxic documents held out
    own = queries.op9_toxicity(spark, more).toPandas().merge(pd.read_parquet(f"{more}/labels.parquet"), on="doc_id").query("held_out")
    assert own.predicted[own.toxic == 1].mean() > 0.88 and own.predicted[own.toxic == 0].mean() < 0.01


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {f} AS SELECT * FROM '{SF}/{f}.parquet'")
    found, said = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert sorted(said.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted((tuple(r[said.columns.index(c)] for c in columns) for r in said.fetchall()), key=str)


def test_clashing_columns(spark):
    names = ["__id", "__sha", "__sha_of", "__rid", "__key", "__kept", "score", "kept", "spans", "fp", "n", "count", "y", "bucket", "h"]
    rows = [r for r in made(9, 30) if r[0] not in (None, 32)]
    docs = spark.createDataFrame([(*r, *[None if i % 3 else f"{n}{r[0]}" for i, n in enumerate(names)]) for r in rows], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    none = spark.createDataFrame([], "doc_id long, toxic int, count long")
    for f in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, suffix_dedup.remove_repeats, lambda d: toxicity.drop_toxic(d, none)):
        found = f(docs)
        assert found.columns == docs.columns
        left = found.collect()
        assert left and all(r[n] == (None if i % 3 else f"{n}{r.doc_id}") for r in left for i, n in enumerate(names))
        assert f(docs.limit(0)).count() == 0
    for f in (exact_dedup.exact_dedup, simhash.simhash_components, suffix_dedup.suffix_dedup):
        assert f(docs).count() == len(rows)


def naive_ftrl(examples, y, epochs):
    """Plain FTRL-proximal, one coordinate at a time."""
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0
    l1 = toxicity.LEAST_L1 + len(y) / toxicity.L1_EXAMPLES
    weight = [len(y) / 2 / max(1, y.count(k)) for k in (0, 1)]

    def w(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for x, k in zip(examples, y, strict=True):
            now = {i: w(i) for i in x}
            g = weight[k] * (1 / (1 + np.exp(-(sum(now.values()) + bias))) - k)
            for i in x:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * now[i]
                n[i] += g * g
            bias_n += g * g
            bias -= toxicity.ALPHA * g / (toxicity.BETA + bias_n**0.5)
    return {i: w(i) for i in z if w(i)}, bias


def toxic_texts():
    rng = np.random.default_rng(2)
    return [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) + (" vile" if i % 4 == 0 else "") for i in range(400)], [int(i % 4 == 0) for i in range(400)]


def naive_features(text, bits=toxicity.BITS):
    import re
    import zlib

    full = 2**32
    words = re.findall(r"\w+", text.lower())
    h = [zlib.crc32(w.encode()) for w in words]
    made = [x * 0x2545F491 for x in h]
    made += [(a * 0x9E3779B1 % full ^ (b + 0x85EBCA77) % full) * 0xC2B2AE3D for a, b in zip(h, h[1:])]
    made += [(a * 0x85EBCA77 % full ^ (b + 0x9E3779B1) % full) * 0x27D4EB2F for a, b in zip(h, h[2:])]
    stems = [w[:4] for w in words if len(w) > 4]
    for s in set(stems):
        made += [(zlib.crc32(s.encode()) + c) % full * 0x165667B1 for c in (1, 2, 4) if stems.count(s) >= c]
    return sorted({(x % full ^ (x % full >> 15)) * 0x2C1B3C6D % full >> (32 - bits) for x in made})


def test_features_equal_naive():
    random.seed(6)
    parts = ["walk", "walks", "walking", "Straße", "é", "réeuxpa", "réeuxle", ",", "\n", "1_2"]
    for n in (0, 1, 2, 3, 10, 200):
        text = " ".join(random.choice(parts) for _ in range(n))
        for bits in (20, 8):
            assert toxicity.Hasher(bits).features(text).tolist() == naive_features(text, bits)
    once, often = (set(naive_features(" ".join(["walker"] * n))) for n in (1, 4))
    assert once < often


def test_ftrl_equals_naive():
    texts, y = toxic_texts()
    hasher = toxicity.Hasher()
    examples = [hasher.features(t) for t in texts]
    ftrl = toxicity.Ftrl((300, 100))
    for _ in range(2):
        for x, k in zip(examples, y, strict=True):
            ftrl.learn(x, k)
    kept, weights, bias = ftrl.model()
    want, want_bias = naive_ftrl([x.tolist() for x in examples], y, 2)
    assert kept.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in kept.tolist()], rtol=1e-5) and abs(bias - want_bias) < 1e-9
    scores = toxicity.Scorer((kept, weights, bias)).scores(["alpha beta vile", "alpha beta gamma", None, ""])
    assert scores[0] >= 0.5 > scores[1] and len(kept) < 400 and scores[2] == scores[3] < 0.5


def test_toxicity_stage_equals_classifier(spark):
    texts, y = toxic_texts()
    rows = [(i, t, k) for i, (t, k) in enumerate(zip(texts, y, strict=True))]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(0, "vile vile"), (None, "vile"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.classify_toxicity(docs, labels).collect()
    assert len(found) == 403 and all(r.predicted == (r.score >= 0.5) for r in found) and 90 < sum(r.predicted for r in found) < 110
    assert toxicity.drop_toxic(docs, labels).count() == sum(1 - r.predicted for r in found)
    # Labels without a sign in the texts: nothing is toxic, for both.
    dull = spark.createDataFrame([(i, "the same words") for i in range(20)], "doc_id long, text string")
    half = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert not any(r.predicted for r in toxicity.classify_toxicity(dull, half).collect()) and toxicity.drop_toxic(dull, half).count() == 20
    again = [toxicity.fit_toxicity(docs, labels) for _ in range(2)]
    assert all(np.array_equal(a, b) for a, b in zip(*again, strict=True))


def naive_trees(x, y, weight, trees, depth, bins):
    """The same boosting by trying every split of every node on its own rows; trees as nested tuples."""
    edges = [sorted({float(v) for v in np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")}) for j in range(x.shape[1])]
    mean = (weight * y).sum() / weight.sum()
    start = np.log(mean / (1 - mean))
    margin, made = np.full(len(x), start), []

    def grow(rows, level, g, h):
        if level == depth:
            return -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2)
        best = (1e-9, None, None)
        for j in range(x.shape[1]):
            for e in edges[j]:
                left = rows[x[rows, j] <= e]
                gl, hl, ga, ha = g[left].sum(), h[left].sum(), g[rows].sum(), h[rows].sum()
                if hl >= quality.LEAST_WEIGHT and ha - hl >= quality.LEAST_WEIGHT:
                    gain = gl**2 / (hl + quality.L2) + (ga - gl) ** 2 / (ha - hl + quality.L2) - ga**2 / (ha + quality.L2)
                    if gain > best[0] + 1e-12:
                        best = (gain, j, e)
        _, j, e = best
        if j is None:
            j, e = 0, np.inf
        return j, e, grow(rows[x[rows, j] <= e], level + 1, g, h), grow(rows[x[rows, j] > e], level + 1, g, h)

    def walk(tree, v):
        while isinstance(tree, tuple):
            tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        made.append(grow(np.arange(len(x)), 0, weight * (p - y), weight * p * (1 - p)))
        margin = margin + np.array([walk(made[-1], v) for v in x])
    return lambda v: start + sum(walk(t, v) for t in made)


def test_trees_equal_naive_search():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)).round(1)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.3, 300) > 0).astype(float)
    weight = np.where(y == 1, 1.3, 0.8)
    margin = naive_trees(x, y, weight, 5, 3, 8)
    found = quality.fit_trees(x, y, weight, trees=5, depth=3, bins=8)
    new = rng.normal(size=(200, 4))
    assert np.allclose(found.margin(np.concatenate((x, new))), [margin(v) for v in (*x, *new)])
    # Vectorised traversal against one row and one node at a time.
    for v in new:
        total = found.start
        for feature, threshold, leaf in zip(found.feature, found.threshold, found.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if v[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - found.margin(v[None])[0]) < 1e-9


def naive_phrases(sample, text):
    """Longest-match parse of a whole text by looking for substrings."""
    sample, n, phrase = "".join(map(chr, sample)), 1, ""
    for c in map(chr, text):
        if phrase + c in sample:
            phrase += c
        else:
            n, phrase = n + 1, c if c in sample else ""
    return n


def test_phrases_equal_naive_parse():
    rng = np.random.default_rng(0)
    for trial, few in enumerate((24, 24, 24, 1, 10**9)):
        classes = int(rng.integers(3, 500))
        draw = lambda n: rng.integers(0, classes, n) if trial % 2 else np.minimum(rng.geometric(0.5, n), classes) - 1  # noqa: B023, E731
        samples = {f"l{k}": draw(rng.integers(0, 900)) for k in range(5)}
        texts = [np.resize(samples["l1"], rng.integers(1, 1500)) if i % 3 == 0 and len(samples["l1"]) else draw(rng.integers(0, 900)) for i in range(40)]
        letters = language_id.Letters("")
        letters.classes = classes
        parser = language_id.Parser(letters, sorted(samples), *language_id.automata(samples, classes))
        language_id.FEW, kept = few, language_id.FEW
        found = parser.phrases(texts)
        language_id.FEW = kept
        assert found.tolist() == [[naive_phrases(samples[k], t) for k in sorted(samples)] for t in texts]


def test_many_languages_and_letters(spark):
    """100 languages with 500 letters of their own between them; texts that open with one shared header."""
    rng = random.Random(5)
    header = "the same licence opens every text " * 30
    words = {k: ["".join(chr(0x4E00 + 5 * k + rng.randrange(9)) for _ in range(3)) for _ in range(40)] for k in range(100)}
    rows = [(i, header + " ".join(rng.choice(words[i % 100]) for _ in range(150)), f"l{i % 100:02d}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify_language(docs).collect()}
    held = [i for i, *_ in rows if found[i].held_out]
    assert len(held) > 200 and sum(found[i].lang_pred == rows[i][2] for i in held) > 0.95 * len(held)


def test_classifiers_edge_rows(spark):
    rows = made(8, 10)
    docs = frame(spark, rows).withColumn("lang", F.lit("en"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify_quality(docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.classify_toxicity(docs, none).collect()} == {0} and toxicity.drop_toxic(docs, none).count() == len(rows)
    for f in (quality.classify_quality, toxicity.classify_toxicity):
        assert f(docs.limit(0), none).count() == 0
    found = language_id.identify_language(docs).collect()
    assert len(found) == len(rows) and all(r.lang_pred == "und" for r in found if r.score == 0)
    assert language_id.identify_language(docs.limit(0)).count() == 0


def jaccard_classes(rows):
    """Smallest id of each row's component by all pairs of 5-word Jaccard similarity 0.8 or more."""
    part, least = brute_similar(rows), {}
    for (d, _), p in zip(rows, part, strict=True):
        least[p] = min(d, least.get(p, d))
    return {d: least[p] for (d, _), p in zip(rows, part, strict=True)}


def test_pipeline(spark):
    """Each stage against brute force on what the one before kept."""
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialise(stage(spark, now, SF), f"test-{name}")
        assert now.columns == docs.columns
        steps[name] = {r.doc_id: r.text for r in now.collect()}
    predicted = {r.doc_id: r.predicted for r in queries.op9_toxicity(spark, SF).collect()}
    clean = steps["toxicity"]
    assert set(clean) == {d for d, p in predicted.items() if not p}
    first = {}
    for d in sorted(clean):
        first.setdefault((clean[d] or "").encode().lower(), d)
    assert set(steps["exact_dedup"]) == set(first.values())
    rows = sorted(steps["exact_dedup"].items())
    least = jaccard_classes(rows)
    wanted = {d for d in least if least[d] == d}
    assert set(steps["near_dedup"]) >= wanted and len(steps["near_dedup"]) - len(wanted) <= 0.1 * (len(rows) - len(wanted))
    rows = sorted(steps["near_dedup"].items())
    removed = {d: n for d, _, n, _, _ in brute_repeats(rows)}
    for d, t in rows:
        left = steps["repeated_passages"][d]
        assert (left == t) == (removed[d] == 0) and 0 <= len((left or "").encode()) - (len((t or "").encode()) - removed[d]) <= 6 * len(t or "") / 200
    packed = corpus_pipeline.packing(spark, now, SF).collect()
    tokenizer = Tokenizer.from_file(P.path(corpus_pipeline.TOKENIZER))
    assert {r.doc_id: r.text for r in packed} == steps["repeated_passages"] and len(packed) == len(rows)
    assert all(r.n_tokens == len(tokenizer.encode(r.text or "", add_special_tokens=False)) for r in packed)


def test_pipeline_edge_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, extra columns of clashing names, and nothing at all."""
    extra = ["__rid", "__kept", "rid", "score", "bucket", "n_tokens", "h"]
    rows = [(*r, "en", "web", 3) + ("x",) * len(extra) for r in [*made(9, 20), (None, None), (None, "only here, with a null id"), (5, "another text with an id that is taken")]]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{c} string' for c in extra)}")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for now in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.materialise(stage(spark, now, str(tmp_path)), f"edge-{name}")
            assert now.columns == docs.columns
        packed = corpus_pipeline.packing(spark, now, str(tmp_path)).collect()
        assert sorted(map(str, (r.text for r in packed))) == sorted(str(r.text) for r in now.collect())
    assert not packed


def test_clashing_columns_of_queries(spark, tmp_path):
    """Operators that give their own columns take no notice of others, whatever their names."""
    P = pytest.importorskip("public_tokenizers")
    names = ["rid", "h", "n", "y", "x", "count", "score", "lang_pred", "held_out", "predicted", "n_tokens", "n_bytes", "content_digest", "bucket", "ids", "fp", "norm", "hash", "prefix", "place", "of"]
    rows = made(10, 20)
    docs = spark.createDataFrame([(*r, "en", *["z"] * len(names)) for r in rows], f"doc_id long, text string, lang string, {', '.join(f'{n} string' for n in names)}")
    labels = spark.createDataFrame([(i, i % 2, i % 2, "z", "z") for i in range(20)], "doc_id long, quality int, toxic int, y string, count string")
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    runs = [
        lambda d: language_id.identify_language(d),
        lambda d: quality.classify_quality(d, labels),
        lambda d: toxicity.classify_toxicity(d, labels),
        lambda d: token_counts.token_counts(d, P.path("byte_bpe_50k.json"), str(tmp_path / "cache")),
        lambda d: packing.pack(d.select("doc_id", F.length("text").alias("n_tokens"), "bucket")),
        lambda d: bpe.bpe_round_trip(d, ranks, P.PATTERN),
    ]
    for run in runs:
        found = run(docs)
        assert sorted((r.doc_id for r in found.collect()), key=str) == sorted((d for d, _ in rows), key=str)
        assert run(docs.limit(0)).count() == 0


def test_long_texts(spark, tmp_path):
    """Texts of megabytes: many words, one word, one letter, the same passage over and over."""
    P = pytest.importorskip("public_tokenizers")
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    prose = " ".join(rng.choice(words) for _ in range(300_000))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(0, prose), (1, "x" * 1_500_000), (2, (passage + "\n") * 3000), (3, prose[:1000] + passage), (4, "short text")]
    docs = frame(spark, rows).withColumn("lang", F.lit("en")).repartition(2)
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert found[2].n_removed == found[2].n_bytes and found[1].n_removed == 1_500_000 and found[0].n_removed == 1000 and found[3].n_removed == len(rows[3][1]) and found[4].n_removed == 0
    assert {r.doc_id: r.kept for r in exact_dedup.exact_dedup(docs).collect()} == dict.fromkeys(range(5), True)
    prints = {r.doc_id: r.fingerprint for r in simhash.simhash_components(docs).collect()}
    assert prints == {d: f"{simhash.fingerprint(t):016x}" for d, t in rows}
    assert corpus_pipeline.near_dedup(spark, docs.drop("lang"), SF).count() == 5
    assert {r.lang_pred for r in language_id.identify_language(docs).collect()} == {"en"}
    none = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify_quality(docs, none).count() == 5 and toxicity.drop_toxic(docs, none).count() <= 5
    import tiktoken
    from tokenizers import Tokenizer

    ranks = bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), str(tmp_path / "cache")).collect()}
    for d, t in rows:
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        if d != 1:
            assert got[d].n_tokens == len(encoding.encode_ordinary(t)) and counted[d] == len(tokenizer.encode(t, add_special_tokens=False))


def test_bpe_blocks(monkeypatch):
    """Small blocks and parts: texts go on from one to the next."""
    import regex
    import tiktoken

    from weirmark.llm.units import unicode_pattern

    P = pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges, find = bpe.Merges(ranks), regex.compile(unicode_pattern(P.PATTERN)).findall
    rng = random.Random(3)
    texts = ["", "a  b   c \n x\x1c y 　 z  ", "zz" * 300, " anderererble " * 9, " " * 50 + "x " * 100, *("".join(rng.choice("ab0é \n\t") for _ in range(2000)) for _ in range(9)), "".join(rng.choice("abcdefABCDEF0123456789+/=") for _ in range(3000))]
    for block, distinct, part in ((24 << 20, 4 << 20, 2 << 20), (3000, 900, 300)):
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "DISTINCT", distinct)
        monkeypatch.setattr(bpe, "PART", part)
        assert [x.tolist() for x in merges.encode(iter(texts), find)] == [encoding.encode_ordinary(t) for t in texts]
    for _ in range(200):
        word = "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 40)))
        if word.encode() not in ranks:
            assert merges.one_by_one(word.encode()).tolist() == merges.replay([word.encode()])[0].tolist()


def test_links_follow_no_collision_of_keys(spark):
    """A key tells every row apart, also rows that are equal in all columns."""
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, None)]
    found = common.keyed(frame(spark, rows), "doc_id", "key").collect()
    assert len({r.key for r in found}) == 4
    assert {r.key for r in common.keyed(frame(spark, rows[1:2]), "doc_id", "key").collect()} == {1}


def test_token_cache_is_per_tokenizer(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    df, cache = frame(spark, [(0, "one two three"), (1, "one two three"), (2, None)]), str(tmp_path / "cache")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(P.path(name))
        found = {r.doc_id: r.n_tokens for r in token_counts.with_token_counts(df, P.path(name), cache).collect()}
        assert found == {d: len(tokenizer.encode(t, add_special_tokens=False)) for d, t in ((0, "one two three"), (1, "one two three"), (2, ""))}
    assert len(list((tmp_path / "cache").glob("tokenizer_digest=*"))) == 2
