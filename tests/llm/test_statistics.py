"""Language-model scores, clustering and resampling against brute force, on the given tables and on hostile small ones."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, HOSTILE, LONG, lower, words

from mailpolicy.llm import clustering, maxent, queries, resampling, topk
from mailpolicy.llm.common import crc_remainder, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named as those of results and intermediate tables are."""
    df = spark.createDataFrame(HOSTILE, DOCS)
    for c in ("score", "rank", "row", "held", "token", "training", "codes", "weight", "n", "__at", "__part", "bucket"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


# --- 11


def split(text):
    out, word = [], ""
    for c in lower(text):
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] if word else out, ""
        else:
            word += c
    return (out + [word] if word else out) + [None]


def _base(rows, held):
    """n_tokens, n_known, N and base score of each row."""
    known = {t: split(t) for _, t in rows}
    c = Counter(x for i, t in rows if not held(i) for x in known[t])
    n, v = sum(c.values()), len(c)
    return [(i, len(known[t]), sum(x in c for x in known[t]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in known[t])) for i, t in rows]


def _close(got, expected):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    expected = sorted(expected, key=repr)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert np.allclose([g[4] for g in got], [e[4] for e in expected], rtol=1e-9)


def _seventh(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("buffer, head", [(maxent.BUFFER, maxent.HEAD), (64, 500)])
def test_base_scores(spark, hostile, monkeypatch, buffer, head):
    monkeypatch.setattr(maxent, "BUFFER", buffer)
    docs = hostile.select("doc_id", "text").union(table(spark, SF, "documents").filter("doc_id < 100").select(F.col("doc_id") + 1000, "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _close(maxent.scored(docs, crc_remainder("doc_id", 7) == 2, head).collect(), _base(rows, _seventh))
    _close(maxent.scored(hostile, crc_remainder("doc_id", 7) == 2, head).collect(), _base(HOSTILE, _seventh))


def test_language_model_scores_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op11_maxent(spark, sf).collect()
    assert len(rows) == 10_000 and all(r.held_out == _seventh(r.doc_id) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.score > r.base_score for r in held]) > 0.95
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.15
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_order_of_words_matters(spark):
    docs = spark.createDataFrame([(i, "the red fox saw the blue dog near a small house " * 20) for i in range(300)], DOCS)
    asked = [(1000, "the red fox saw the blue dog near a small house"), (1001, "house small a near dog blue the saw fox red the")]
    given = docs.union(spark.createDataFrame(asked, DOCS))
    found = {r.doc_id: r for r in maxent.scored(given, F.col("doc_id") >= 1000).filter("doc_id >= 1000").collect()}
    assert found[1000].base_score == pytest.approx(found[1001].base_score)
    assert found[1000].score > found[1001].score + 2


def test_probabilities_of_all_tokens_sum_to_one(spark):
    docs = table(spark, SF, "documents").select("doc_id", F.lit(False).alias("held"), "text")
    counts = maxent.counted(docs)
    v = maxent.vocabulary(counts, 1000)
    assert 500 < len(v.tokens) <= 1000
    shared = spark.sparkContext.broadcast(v)
    model = maxent.trained(maxent.encoded(docs, shared), v, shared)
    tokens, times = (np.array(c) for c in zip(*[(r.token, r.training) for r in counts.collect()]))
    h = tokens.view(np.uint64)
    at = v.places(h)
    codes = np.where(at < len(v.tokens), v.codes[at], maxent.tail_codes(h)).astype(np.uint32)
    assert (codes < maxent.CLASSES * maxent.CLASS_WORDS).sum() == maxent.CLASSES * maxent.CLASS_WORDS
    histories = [np.array([1, 2, 3], np.uint32), codes[-3:], codes[codes < 100][:3]]
    for history in histories:
        features = next(maxent._targets(iter([np.r_[history, codes[:1]]])))[2][:, -1:]
        logs = model.logs(codes, np.repeat(features, len(codes), axis=1))
        logs += np.where(codes >= maxent._TAIL, np.log10(times + 1), 0)
        unseen = np.arange(maxent.TAIL_CLASSES, dtype=np.uint32) | np.uint32(maxent._TAIL)
        left = model.logs(unseen, np.repeat(features, len(unseen), axis=1))
        assert (10**logs).sum() + (10**left).sum() == pytest.approx(1, rel=1e-4)


def test_hashes_tell_words_apart():
    texts = [LONG, "a b\tc A\x0bB", "", None, "é　x \x1c", "x" * 300_000 + " y", "ab ba aab aba baa"]
    h = np.concatenate(list(maxent._hashed(texts)))
    tokens = [x for t in texts for x in split(t)]
    assert len(h) == len(tokens)
    assert len({(a, b) for a, b in zip(h.tolist(), tokens)}) == len(set(h.tolist())) == len(set(tokens))
    assert list(maxent._targets(iter([]))) == []


def test_language_model_of_empty_tables(spark):
    assert maxent.scored(spark.createDataFrame([], DOCS), F.lit(False)).count() == 0
    rows = maxent.scored(spark.createDataFrame([(1, "a b"), (2, None)], DOCS), F.lit(True)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in rows)


# --- 12


def _clusters(rows, k, rounds, width, seed=2, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inside = Counter()
    for _, d, j in found:
        inside[j] += d
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, j, long(d), long(inside[j]), long(sum(inside.values())), text[j]) for i, d, j in found), key=repr)


@pytest.mark.parametrize("largest", [2.0, 1e6, 1e15])
def test_clusters_of_hostile_vectors(spark, largest):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5) * largest / 2]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, [0.25] * 5), (None, [0.25] * 5), (400, None), (401, [1.0]), (402, [None] * 5), (403, [float("nan")] * 5), (404, [float("-inf")] * 5), (405, []), (406, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("cluster", "distance", "x", "n", "sums"):
        vectors = vectors.withColumn(c, F.lit("x"))
    got = clustering.clustered(vectors.repartition(4), k=11, rounds=3, width=5)
    rows_of = sorted(map(tuple, got.collect()), key=repr)
    expected = _clusters(rows, 11, 3, 5)
    if largest < 1e15:
        assert rows_of == expected
    else:
        assert [r[:2] + r[5:] for r in rows_of] == [r[:2] + r[5:] for r in expected] and any(r[2] is None for r in rows_of)
        assert all(r[2] == e[2] for r, e in zip(rows_of, expected))
    assert clustering.clustered(vectors.limit(0), width=5).count() == 0
    few = vectors.filter("vec_id in (1, 2, 401)")
    assert {r.distance for r in clustering.clustered(few, k=11, rounds=2, width=5).collect()} == {0}
    with pytest.raises(ValueError):
        clustering.clustered(vectors, k=10_000)


def test_tournament_against_all_distances():
    rng = np.random.default_rng(2)
    for largest in (3, 1000, 10**8, 10**12):
        c = rng.integers(-largest, largest + 1, (17, 6))
        c[5] = c[3]
        x = np.concatenate([rng.integers(-largest, largest + 1, (400, 6)), c, (c[0] + c[1]) // 2 * np.ones((3, 6), np.int64)])
        tournament = clustering.Tournament(c.tolist())
        best = tournament.nearest(x)
        all_ = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        assert best.tolist() == [d.index(min(d)) for d in all_]
        assert tournament.distances(x, best) == [min(d) for d in all_]


# --- 10: components of any size


@pytest.mark.parametrize("largest", [30.0, 1e5, 1e12, 1e30])
def test_topk_of_large_components(spark, largest):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 5) * largest / 4]) for i in range(250)]
    rows += [(300, [0.001, 0.0, 0.0, 0.0, 0.0]), (301, [0.0] * 5), (302, [-largest, 20000.0, 30000.0, 17000.0, 40000.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.search(vectors, F.col("vec_id") % 100 == 0, block=2).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q in (0, 100, 200, 300):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert mine == [(k + 1, i, -s if -(2**63) <= -s < 2**63 else None) for k, (s, i) in enumerate(best)]


def test_keys_are_in_the_order_of_scores():
    scores = sorted({s * (b + d) for s in (1, -1) for b in (0, 255, 256, 65535, 2**62, 2**63, 10**40, 10**80) for d in (0, 1, 7)})
    assert sorted(scores, key=topk._key) == scores


# --- 13


def _drawn(rows, target, most=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets
    s, t = (Counter(bucket(f) for x in side for f in features(x)) for side in ([t for _, t in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        out.append([i, len(f), len(words(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("most, percent, piece", [(1, 10, 1 << 20), (3, 50, 40)])
def test_resampling(spark, hostile, monkeypatch, most, percent, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling, "RANKED_ROWS", 7)
    docs = hostile.select("doc_id", "text").union(table(spark, SF, "documents").filter("doc_id < 120").select(F.col("doc_id") + 1000, "text"))
    docs = docs.withColumn("__row", F.lit(1)).withColumn("rank", F.lit(2))
    target = table(spark, SF, "benchmark")
    got = resampling.resample(docs, target, most=most, percent=percent)
    expected = _drawn([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], most, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == expected


def test_resampling_of_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, LONG)] * 40 + [(2, "few words")] * 3, DOCS).repartition(5)
    ranks = [r["rank"] for r in resampling.resample(docs, docs, percent=50).orderBy("rank").collect()]
    assert [x for x in ranks if x] == list(range(1, 21)) and len(ranks) == 43
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    assert resampling.resample(docs, none).count() == 43


def test_crcs_of_features_of_all_lengths():
    rng = np.random.default_rng(3)
    lengths = [*range(1, 70), 255, 256, 257, 511, 512, 513, 5000, 70_000]
    features = [rng.bytes(n) for n in lengths for _ in range(3)]
    assert resampling.crc32s(features).tolist() == [zlib.crc32(x) for x in features]
    assert resampling.crc32s([]).tolist() == []
