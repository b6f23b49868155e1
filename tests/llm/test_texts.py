import glob
import os
import random
import re

import duckdb
import numpy as np
import pytest

from tessella.llm import components, lm, mixing, parity_join, preference, quality
from tessella.llm.queries import QUERIES, SQL

from .helpers import LONG, TEXTS, documents, none, write

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), tables.execute(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [sorted(df[cols].astype(str).itertuples(index=False, name=None)) for df in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", ["op2_mix_sources", "op8_jaccard_groups"])
def test_odd_rows_equal_sql(spark, tmp_path, name):
    texts = [*TEXTS, *(f"a b c d e f g h i j k l m n o p q r s t {i}" for i in range(5))]
    if name == "op2_mix_sources":
        texts = [t for t in texts if t is None or "\x00" not in t]
    folder = write(documents(spark, texts), tmp_path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), c.execute(SQL[name]).df()
    cols = sorted(want.columns)
    rows = [sorted(df[cols].astype(str).itertuples(index=False, name=None)) for df in (got, want)]
    assert rows[0] == rows[1]


# mixing


def mixed(df, **options):
    return mixing.plan_mix(df, **options)


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixed(df)
    out = plan.decisions().toPandas()
    again = mixed(df.repartition(5)).decisions().toPandas()
    assert out.sort_values("id").taken.tolist() == again.sort_values("id").taken.tolist()
    assert (out.taken <= 2 * out["size"]).all() and set(out.copies) <= {0, 1, 2}
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 60
        assert g.target.iloc[0] <= 2 * g["size"].sum() + 1e-6
    assert abs(out.groupby("source").target.first().sum() - 1.5 * out["size"].sum()) < 1e-3
    repeated = plan.repeat(df).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert all(repeated.get(r.id, 0) == r.copies for r in out.itertuples())


def test_mix_odd_tables(spark):
    assert mixed(none(spark)).decisions().count() == 0 and mixed(none(spark)).repeat(none(spark)).count() == 0
    df = documents(spark)
    out = mixed(df).decisions().toPandas()
    assert len(out) == len(TEXTS) and out.taken.max() <= 2 * out["size"].max()
    assert (out[out["size"] == 0].taken == 0).all()
    assert mixed(df).repeat(df).columns == df.columns
    same = documents(spark, ["a b c"], copies=40)  # repeated rows share a rank
    assert len(set(mixed(same).decisions().toPandas().taken)) == 1


def test_mix_prefers_by_weight(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "a b c d", "s") for i in range(2000)], "doc_id long, text string, source string")
    out = mixed(df, weights=(1,), share=0.5, weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).decisions().toPandas()
    even, odd = (out[out.id % 2 == k].copies.mean() for k in (0, 1))
    assert abs(even - 0.75) < 0.06 and abs(odd - 0.25) < 0.06 and abs(out.taken.sum() - out.target[0]) <= 4


def test_water_level(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 10.0, 1.0), ("b", 100.0, 1.0), ("c", 100.0, 2.0)], "k string, cap double, w double")
    rows = {r.k: r.filled for r in mixing.water_fill(df, F.col("cap"), F.col("w"), F.lit(100.0), [], [F.col("k")]).collect()}
    assert rows == {"a": 10.0, "b": 30.0, "c": 60.0}
    rows = mixing.water_fill(df, F.col("cap"), F.col("w"), F.lit(1000.0), [], [F.col("k")]).collect()
    assert {r.k: r.filled for r in rows} == {"a": 10.0, "b": 100.0, "c": 100.0}


# near copies


def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 50)])
def test_groups_against_brute_force(spark, k, num):
    rng = random.Random(k)
    passage = [f"p{i}" for i in range(60)]
    texts = list(TEXTS)
    for _ in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 20, 40, 120, 400]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.02, 0.04, 0.08]))):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    want = brute(texts, k, num, 100)
    rows = {r.doc_id: r for r in parity_join.jaccard_groups(documents(spark, texts), k, num, 100).collect()}
    assert [(rows[i].n_shingles, rows[i].component_id) for i in range(len(texts))] == want


def test_large_groups_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK_DOCS", 32)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        copy = list(base)
        copy[i] = f"x{i}"
        texts.append(" ".join(copy))
    rows = parity_join.jaccard_groups(documents(spark, [" ".join(base)] + texts), 3, 90, 100).collect()
    assert {r.component_id for r in rows} == {0}


def test_near_copies_odd_tables(spark):
    assert parity_join.jaccard_groups(none(spark)).count() == 0
    df = documents(spark, copies=2)
    kept = parity_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 0 in ids and 1 not in ids and 11 not in ids and {2, 3, 4} <= ids
    lost = df.selectExpr("cast(null as long) AS doc_id", "text")
    assert all(r.component_id is None for r in parity_join.jaccard_groups(lost).collect())


def test_near_copies_decide_by_row(spark):
    a, b = "one two three four five six seven", "quite another text of some eight plain words"
    df = spark.createDataFrame([(3, a), (3, a), (5, a), (5, b), (7, None), (7, None), (None, a)], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in parity_join.keep_one_of_each(df).collect())
    assert kept == [(0, a), (3, a), (5, b), (7, ""), (7, "")]


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 20).astype(np.uint64)])
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        for x, y in ((parity_join.sketch(a, 17), parity_join.sketch(b, 17)), (parity_join.plain(a), parity_join.fold(parity_join.plain(b), len(parity_join.plain(a))))):
            if len(x) == len(y):
                assert int(np.bitwise_count(x ^ y).sum()) <= apart


def test_filter_lets_all_its_rows_through(spark):
    from pyspark.sql import functions as F

    from tessella.llm import bloom

    df = spark.range(3000).select(F.xxhash64("id").alias("h"))
    f = bloom.build(df.repartition(3))
    own = np.array([r.h for r in df.collect()], np.int64)
    others = np.array([r.h for r in spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    assert f.has(own).all() and f.has(others).mean() < 0.05
    assert not bloom.build(df.limit(0)).has(others).any()


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 300)] + [(400 + rng.randrange(50), 400 + rng.randrange(50)) for _ in range(80)] + [(500, 900 + i) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# quality


def test_identity_of_the_machine():
    rng = np.random.default_rng(0)
    m = quality.Machine(50, 3)
    m.w = rng.normal(size=50).astype(np.float32)
    m.v = rng.normal(size=(50, 3)).astype(np.float32)
    slots, values = np.array([1, 4, 9, 30]), np.array([0.5, 1.0, 2.0, 0.1], np.float32)
    y, _ = m.margins(slots, values, np.array([0]))
    want = m.w0 + sum(m.w[i] * x for i, x in zip(slots, values, strict=True))
    want += sum(float(m.v[slots[a]] @ m.v[slots[b]]) * values[a] * values[b] for a in range(4) for b in range(a + 1, 4))
    assert abs(y[0] - want) < 1e-4


def test_quality_on_held_out_rows(spark):
    out = QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = out.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.95
    assert out.score.between(0, 1).all() and len(out) == 1000


def test_quality_odd_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, 0, 0), (4, None, 0), (5, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(documents(spark, copies=2), labels).collect()
    assert len(out) == 2 * len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(none(spark), labels).count() == 0
    nothing = quality.classify(documents(spark), labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    df = documents(spark)
    assert quality.keep_good(df, labels, threshold=0.0).count() == len(TEXTS) and quality.keep_good(df, labels, threshold=1.1).count() == 0
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.score(df.drop("n_chars"), quality.fit(df, labels)).count() == len(TEXTS)


# language model


def test_base_scores_and_counts(spark, tmp_path):
    import math
    import zlib
    from collections import Counter

    rng = random.Random(2)
    texts = [*TEXTS, *(" ".join(f"Tok{int(rng.expovariate(0.05))}" for _ in range(200)) for _ in range(40))]
    out = {r.doc_id: r for r in QUERIES["op5_lm_scores"](spark, write(documents(spark, texts), tmp_path)).collect()}
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    docs = held.count(False)
    total, distinct = sum(counts.values()) + docs, len(counts) + 1
    for i, ws in enumerate(words):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws) + math.log10((docs + 1) / (total + distinct + 1))
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(w in counts for w in ws) + 1, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and -1e7 < r.score < 0


def test_rare_words_pass_the_buckets(spark, tmp_path, monkeypatch):
    folder = write(documents(spark), tmp_path)
    one = {r.doc_id: r.base_score for r in QUERIES["op5_lm_scores"](spark, folder).collect()}
    monkeypatch.setattr(lm, "HEAD", 3)
    monkeypatch.setattr(lm, "BUCKET", 500)
    two = {r.doc_id: r.base_score for r in QUERIES["op5_lm_scores"](spark, folder).collect()}
    assert all(abs(one[i] - two[i]) < 1e-6 * max(1, -one[i]) for i in one)


def test_a_word_is_merged_once_whatever_marks_follow(spark):
    """And has the ids that the library gives it."""
    import public_tokenizers

    from tessella.llm.tokens import Vocabulary

    reader = lm.Reader(Vocabulary(spark, public_tokenizers.path("word_bpe_49k.json")), {})
    library, merged, calls = reader.encoder.library, reader.merged, []
    reader.merged = lambda letters: calls.append(letters) or merged(letters)
    for text in ("Window window, window. WINDOW?! pane; pane", "pane, <|x|> window<| window|< caf\u00e9, caf\u00e9 a-b, ..."):
        ids = reader.read(text.encode())[4]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(" ".join(w.decode() for w in lm.words(text.encode())), add_special_tokens=False).ids
    assert calls.count("window") == 1 and calls.count("pane") <= 2


def test_lm_odd_tables(spark, tmp_path):
    assert QUERIES["op5_lm_scores"](spark, write(none(spark), tmp_path)).count() == 0


def _cycles(n, length=2000):
    """Texts that go round one of two orders of 40 words: word counts tell nothing, neighbours all."""
    names = [a + b for a in "bdfgk" for b in ("at", "en", "ig", "ol", "um", "ar", "et", "in")]
    orders = [names, [names[i * 7 % 40] for i in range(40)]]
    return [" ".join(orders[i % 2][(i + j) % 40] for j in range(length)) for i in range(n)]


def test_lm_learns_from_all_documents(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    df = documents(spark, _cycles(120)).select("doc_id", "text")
    rows = [r for r in lm.score_texts(df, path, windows=1, train_every=1).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)
    again = {r.doc_id: r.score for r in lm.score_texts(df.repartition(7), path, windows=1, train_every=1).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-3 * -r.score for r in rows)


def test_lm_beats_the_base_on_held_out_documents(spark):
    """Of invented prose without a link between words, on the smaller test tables, whole."""
    rows = [r for r in QUERIES["op5_lm_scores"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_classes_and_windows():
    import inspect

    from tessella.llm import attention

    rng = np.random.default_rng(4)
    near = (rng.random((3000, 256)) < 0.1).astype(np.float32)
    counts = np.r_[np.full(2800, 10), np.zeros(200, int)]
    of = attention.classes(near, counts, np.zeros(3000, bool))
    assert of.min() >= 0 and of.max() < attention.CLASSES and len(np.unique(of)) > 900
    assert len(np.unique(of[: attention.ALONE])) == attention.ALONE
    assert inspect.signature(lm.score_texts).parameters["windows"].default >= 40_000


def test_the_share_of_windows_follows_the_input():
    """One in so many windows of every document, whatever the size of the table, and no window twice."""
    import pyarrow as pa

    from tessella.llm import attention

    rng, taken = np.random.default_rng(1), 0
    hashes = rng.integers(0, 2**62, 400)
    for n in (100, 400):
        texts = [np.arange(3000, dtype="<u4").tobytes()] * n
        out = list(lm._window_batches(5000, 16, 0, [pa.RecordBatch.from_arrays([pa.array(hashes[:n]), pa.array(texts)], names=["h", "ids"])]))
        rows = [r for b in out for r in b.column(1).to_pylist()]
        x, y = lm._inputs(rows, 5000)
        assert abs(len(rows) - n * 94 / 16) < 0.2 * n * 94 / 16 and x.shape[1] == attention.SPAN and all(b.column(2).to_pylist() == [True] * b.num_rows for b in out)
        assert ((y == -1) | (y == x[:, attention.CONTEXT : attention.CONTEXT + attention.STEP] + 1) | (y == 0)).all()
        taken = max(taken, len(rows))


def test_every_id_of_every_document_is_a_training_target():
    """As the query is called: from texts to the counts that a shard weighs its change by."""
    import inspect
    from types import SimpleNamespace

    import pyarrow as pa

    from tessella.llm import attention

    every = inspect.signature(lm.score_texts).parameters["train_every"].default
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 3000, n).astype("<u4") for n in (1, 31, 32, 33, 700, 5000)]
    model = attention.Model(np.bincount(np.concatenate(texts), minlength=3000), np.arange(3000) % attention.CLASSES)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array([x.tobytes() for x in texts])], names=["h", "ids"])
    made = pa.Table.from_batches(list(lm._window_batches(model.begin, every, 0, [batch])))
    dealt = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(made), np.int64)), *[made.column(i).combine_chunks() for i in (0, 1)]], names=["shard", "h", "row"])
    [rest] = [r for b in lm._shard_batches(SimpleNamespace(value=model), [dealt]) for r in b.to_pylist() if r["part"] == -1]
    assert np.frombuffer(rest["n"], np.int64).tolist() == [sum(map(len, texts))]


def test_scores_equal_one_id_at_a_time():
    """Batched windows and the two levels of the softmax against plain sums over all ids for one position at a time."""
    from tessella.llm import attention

    rng = np.random.default_rng(9)
    size, ids = 300, rng.integers(0, 300, 150)
    model = attention.Model(np.bincount(ids, minlength=size), rng.integers(0, attention.CLASSES, size))
    x, y = attention.windows(ids, model.begin)
    model.train(x, y, epochs=3, batch=2)
    w, want = {k: v.astype(np.float64) for k, v in model.w.items()}, 0.0
    for at, target in enumerate(ids):
        start = at // attention.STEP * attention.STEP - attention.CONTEXT
        seen = [model.begin if p < 1 else int(ids[p - 1]) for p in range(start, at + 1)]
        e = w["e"][seen] + w["p"][: len(seen)]
        s = (e[-1] @ w["q"]) @ (e @ w["k"]).T
        p = np.exp(s - s.max())
        h = e[-1] + (p / p.sum()) @ (e @ w["v"]) @ w["o"]
        z = h + np.maximum(h @ w["a"] + w["ab"], 0) @ w["b"]
        group = np.exp(z @ w["g"] + w["gb"])
        each = np.exp(np.einsum("d,gde->ge", z, w["u"]) + w["ub"])
        classes = (group / group.sum())[:, None] * each / each.sum(axis=1, keepdims=True)
        all_ids = classes.reshape(-1)[model.of] * 10**model.share
        used = np.unique(model.of)
        assert abs(all_ids.sum() - classes.reshape(-1)[used].sum()) < 1e-9
        want += np.log10(all_ids[target])
    assert abs(model.log10(x, y).sum() - want) < 1e-4 * -want


def test_odd_weights_stay_finite():
    from tessella.llm import attention

    ids = np.arange(100) % 9
    model = attention.Model(np.bincount(ids, minlength=10), np.arange(10))
    x, y = attention.windows(ids, model.begin)
    for factor in (-300.0, 300.0):
        odd = model.copy()
        odd.w["q"] = odd.w["q"] * np.float32(factor)
        odd.w["k"] = odd.w["k"] * np.float32(abs(factor))
        odd.w["g"] = odd.w["g"] * np.float32(1e4)
        assert np.isfinite(odd.log10(x, y)).all() and np.isfinite(odd.gradients(x, y)[0])


def test_attention_is_causal_and_windows_cover_each_id():
    from tessella.llm import attention

    ids = np.arange(1, 100) % 7
    counts = np.bincount(ids, minlength=10)
    model = attention.Model(counts, np.arange(10))
    x, y = attention.windows(ids, model.begin)
    assert y[y >= 0].tolist() == ids.tolist()
    base = model.forward(x)[-1].reshape(len(x), attention.STEP, -1)
    changed = x.copy()
    changed[:, attention.CONTEXT + 5 :] = 3
    after = model.forward(changed)[-1].reshape(len(x), attention.STEP, -1)
    assert np.allclose(base[:, :5], after[:, :5], atol=1e-5) and not np.allclose(base[:, 5:], after[:, 5:], atol=1e-3)


def test_gradients():
    from tessella.llm import attention

    rng = np.random.default_rng(3)
    ids = rng.integers(0, 10, 200)
    model = attention.Model(np.bincount(ids, minlength=10), np.arange(10) * 37)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = attention.windows(ids, model.begin)
    _, g = model.gradients(x, y)
    own = int(model.of[3])
    for name, at in (("k", (1, 3)), ("v", (2, 1)), ("q", (2, 2)), ("o", (0, 1)), ("a", (3, 4)), ("b", (4, 3)), ("g", (1, 1)), ("gb", (2,)), ("u", (own // attention.EACH, 2, own % attention.EACH)), ("ub", (own // attention.EACH, 1)), ("p", (5, 2)), ("ab", (2,))):
        old, step = model.w[name][at], 1e-5
        losses = []
        for s in (step, -step):
            model.w[name][at] = old + s
            losses.append(model.gradients(x, y)[0])
        model.w[name][at] = old
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][at]) < 1e-4, name
    pattern = np.tile([1, 2, 3, 4], 400)
    learned = attention.Model(np.bincount(pattern, minlength=10), np.arange(10) * 50)
    x, y = attention.windows(pattern, learned.begin)
    start = learned.log10(x, y).sum()
    learned.train(x, y, epochs=60, batch=8)
    assert learned.log10(x, y).sum() > 0.2 * start


@pytest.mark.parametrize("name", ["op1_pack_documents", "op2_mix_sources", "op4_quality", "op5_lm_scores", "op8_jaccard_groups", "op9_token_counts"])
def test_rows_without_an_id_are_results(spark, tmp_path, name):
    folder = write(documents(spark, nameless=2), tmp_path)
    write(spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    rows = QUERIES[name](spark, folder).collect()
    assert sum(r.doc_id is None for r in rows) == 2 and {r.doc_id for r in rows} == {None, *range(len(TEXTS))}


# conversations


def test_preference_pairs(spark):
    chosen = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "a"), (3, 0, None, None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no!"), (1, 2, "user", "?"), (3, 0, None, None), (4, 0, "assistant", "q")], "conv_id long, turn long, role string, text string")
    rows = {r.pair_id: r for r in preference.preference_samples(chosen, rejected).collect()}
    assert set(rows) == {1, 2, 3, 4}
    r = rows[1]
    assert r.paired and r.prompt_turns == 1 and r.prompt == "<|user|>\nhi<|end|>\n"
    for side, spans, text in ((r.chosen, r.chosen_spans, "yo<|end|>\n"), (r.rejected, r.rejected_spans, "no!<|end|>\n")):
        assert [side[s.start : s.end] for s in spans] == [text]
    assert not rows[2].paired and rows[2].rejected == "" and rows[2].prompt == ""
    assert rows[3].prompt_turns == 1 and rows[3].chosen == rows[3].rejected == ""
    assert not rows[4].paired and [rows[4].rejected[s.start : s.end] for s in rows[4].rejected_spans] == ["q<|end|>\n"]
    assert preference.preference_samples(chosen.limit(0), rejected.limit(0)).count() == 0


def test_preference_odd_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 0, "user", LONG), (2, None, "user", "é😀")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, prompt string, chosen int")
    out = {r.pair_id: r for r in preference.preference_samples(df, preference.halved(df)).collect()}
    assert out[1].prompt_turns == 1 + (out[1].chosen != out[1].rejected and out[1].chosen.count("assistant") == 1) and LONG in out[1].prompt
    assert out[2].prompt.endswith("é😀<|end|>\n") and out[2].chosen == ""
