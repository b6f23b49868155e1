import numpy as np
import pytest

from tessella.llm import multi_index, norm_search
from tessella.llm.queries import QUERIES

from .helpers import write

SCHEMA = "vec_id long, embedding array<float>, label int, score double, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.5, "x") for i, v in rows], SCHEMA)


def odd(dim):
    return [(1001, None), (1002, [float("nan")] * dim), (1003, [None] * dim), (1004, [float("inf")] + [0.0] * (dim - 1)), (None, [1.0] * dim), (1005, [1.0] * (dim + 1)), (1006, [])]


def brute_products(rows, k, mod, scale):
    ints = {i: [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v] for i, v in rows}
    out = {}
    for q in ints:
        if q % mod == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("size", [0, 1, 7, 900])
@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_products_against_brute_force(spark, monkeypatch, size, spread):
    for name, value in (("BUCKET", 32), ("RUN", 3), ("QUERIES", 8)):
        monkeypatch.setattr(norm_search, name, value)
    rng = np.random.default_rng(size)
    v = (rng.normal(size=(size, 8)) * np.exp(spread * rng.normal(size=(size, 1)))).astype(np.float32)
    if size > 100:
        v[50:90] = v[50]  # ties
        v[95] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    got = {}
    for r in norm_search.top_products(table(spark, rows + odd(8)), k=5, query_mod=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: x for q, x in brute_products(rows, 5, 20, 64).items() if x}
    assert got == want


def test_pruning_happens():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    v = ((centres[rng.integers(0, 12, 600)] + 0.15 * rng.normal(size=(600, 8))) * np.exp(0.15 * rng.normal(size=(600, 1))) * 100).astype(np.int64)
    norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms)
    ids, v, norms = np.arange(600)[order], v[order], norms[order]
    asked = np.arange(0, 600, 30)
    s = norm_search.Searcher(ids[asked], norms[asked], v[asked], 3, np.full(20, -np.inf))
    for a in range(0, 600, 50):
        s.visit(norm_search.Bucket(ids[a : a + 50].astype(np.int64).tobytes(), norms[a : a + 50].tobytes(), v[a : a + 50].tobytes(), 8))
    assert s.skipped and s.by_length and s.by_coordinate
    full = v[asked] @ v.T
    for r, q in enumerate(asked):
        full[r, q] = np.iinfo(np.int64).min + 1
        want = sorted((-x, i) for x, i in zip(full[r].tolist(), ids.tolist(), strict=True))[:3]
        assert [(-int(x), int(i)) for x, i in zip(s.scores[s.rows == r], s.found[s.rows == r], strict=True)] == want


def test_huge_components_stay_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [2e9, -1.0]), (2, [1.0, 1.0]), (3, [-3e9, 5.0])]
    got = [(r.vec_id, r.score) for r in norm_search.top_products(table(spark, rows), k=3, query_mod=20).orderBy("rank").collect()]
    want = brute_products(rows, 3, 20, 64)[0]
    limit = 2**63 - 1
    assert got == [(i, max(-limit - 1, min(limit, s))) for i, s in want]


def test_repeated_rows_are_candidates_and_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])]
    assert [(r.vec_id, r["rank"]) for r in norm_search.top_products(table(spark, rows), k=5).orderBy("rank").collect()] == [(1, 1), (1, 2), (2, 3)]
    assert [(r.vec_id, r["rank"]) for r in multi_index.nearest_rows(table(spark, rows), k=5).orderBy("rank").collect()] == [(2, 1), (1, 2), (1, 3)]


def test_a_given_length_wins_over_the_most_frequent(spark):
    rows = [(0, [1.0]), (20, [2.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (40, [3.0, 0.0])]
    assert {r.query_id for r in norm_search.top_products(table(spark, rows), k=5, dim=1).collect()} == {0, 20}
    assert {r.query_id for r in norm_search.top_products(table(spark, rows), k=5).collect()} == {40}


def test_clustered_data_rerank_little():
    rng = np.random.default_rng(2)
    for spread, low, high in ((0.02, 0.0, 0.1), (50.0, 0.05, 1.0)):
        x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + spread * rng.normal(size=(4000, 16))
        codes = tuple(multi_index.k_means(x[:, a:b], 64) for a, b in ((0, 8), (8, 16)))
        assert low <= multi_index.measured_share(x, codes, 10) <= high


def test_walk_is_in_order():
    rng = np.random.default_rng(4)
    one, two = rng.random(6), rng.random(5)
    counts = rng.integers(0, 4, (6, 5))
    cells = multi_index.walk(one, two, counts.tolist(), int(counts.sum()))
    sums = [one[i] + two[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells) == int((counts > 0).sum())
    part = multi_index.walk(one, two, counts.tolist(), 5)
    assert part == cells[: len(part)] and sum(counts[c] for c in part) >= 5 > sum(counts[c] for c in part[:-1])


def test_recall_on_the_test_table(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    v, ids = np.stack(rows.embedding).astype(np.float64), rows.vec_id.to_numpy()
    found = QUERIES["op6_nearest"](spark, d).toPandas()
    hits = 0
    for q in ids[ids % 100 == 0]:
        dist = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        dist[ids == q] = np.inf
        got = found[found.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 11)) and got.score.is_monotonic_increasing
        assert np.abs(dist[[np.flatnonzero(ids == i)[0] for i in got.vec_id]] - got.score).max() == 0
        hits += len(set(ids[np.lexsort((ids, dist))[:10]]) & set(got.vec_id))
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_nearest_odd_tables(spark, tmp_path):
    few = [(0, [0.0, 1.0]), (100, [1.0, 0.0]), (5, [0.0, 0.0])]
    out = multi_index.nearest_rows(table(spark, few + odd(2))).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in out} == {(0, 1, 100, round(2**0.5, 9)), (100, 1, 0, round(2**0.5, 9))}
    folder = write(table(spark, []), tmp_path, "embeddings")
    assert QUERIES["op6_nearest"](spark, folder).count() == QUERIES["op3_top_products"](spark, folder).count() == 0
    with pytest.raises(ValueError):
        multi_index.nearest_rows(table(spark, few), cells=65)


def test_hot_cell_becomes_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ENTRIES", 16)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 6)).astype(np.float32)
    v[:100] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    out = multi_index.nearest_rows(table(spark, rows), share=1.0).collect()
    for q in (0, 100, 200):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        want = [(int(i), d[i]) for i in np.lexsort((np.arange(300), d))[:10]]
        assert [(r.vec_id, r.score) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == want
