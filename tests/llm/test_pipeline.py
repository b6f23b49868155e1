import random

import corpus_pipeline

import pytest

from .helpers import TEXTS, documents, none, write

from tessella.llm import mixing, quality


def test_stages_keep_their_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(1)
    good = [" ".join(f"w{rng.randrange(500)}" for _ in range(60 + i)) + "." for i in range(40)]
    bad = [" ".join(f"W{(i + k) % 50}!!" for k in range(60)) for i in range(20)]
    texts = good + bad + good[:5]
    docs = documents(spark, texts)
    folder = write(docs, tmp_path)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    write(labels, tmp_path, "labels")
    df, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == docs.columns, name
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        counts.append({r.doc_id for r in df.collect()})
    assert counts[0] == {i for i, t in enumerate(texts) if "!!" not in t}
    assert not counts[1] & set(range(60, 65)) and counts[1] == counts[0] - set(range(60, 65))
    plan = mixing.plan_mix(spark.read.parquet(str(tmp_path / corpus_pipeline.STAGES[1][0])))
    want = {r.id: r.copies for r in plan.decisions().collect() if r.copies}
    got = {r.doc_id: r["count"] for r in df.groupBy("doc_id").count().collect()}
    assert got == want
    packed = corpus_pipeline.STAGES[-1][1](spark, df, folder).collect()
    assert len(packed) == df.count()
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(packed)
    assert quality.fit(docs, labels) is not None


@pytest.mark.parametrize("kind", ["odd", "empty", "null_ids"])
def test_stages_stand_odd_tables(spark, tmp_path, kind):
    """Null and empty and very long texts, repeated rows, null ids, clashing columns, no rows at all."""
    docs = {"odd": lambda: documents(spark, copies=2), "empty": lambda: none(spark), "null_ids": lambda: documents(spark).selectExpr("cast(null as long) AS doc_id", "text", "lang", "source", "n_chars", "score", "length", "ids")}[kind]()
    write(docs, tmp_path)
    write(spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    df, stages = docs, dict(corpus_pipeline.STAGES)
    scored = stages["quality classifier"](spark, df, str(tmp_path))
    assert scored.columns == df.columns and scored.count() <= df.count()
    near = stages["n-gram Jaccard join"](spark, df, str(tmp_path))
    kept = near.collect()
    assert near.columns == df.columns
    if kind == "odd":
        # One row of each text with words (two texts differ in case alone), and all rows without words.
        blank = [t for t in TEXTS if not (t or "").split()]
        assert len(kept) == 2 * len(blank) + len({t.lower().strip() for t in TEXTS if (t or "").split()})
    if kind == "null_ids":
        assert len(kept) == len(TEXTS)
    mixed = stages["mixing sources"](spark, df, str(tmp_path))
    assert mixed.columns == df.columns and mixed.count() <= 2 * df.count()
    packed = stages["best-fit packing"](spark, df, str(tmp_path)).collect()
    assert len(packed) >= df.count() and all(0 <= r.offset <= 4096 - r.length for r in packed)
