import glob
import os

import duckdb
import pytest

from tessella.plans import CORE_QUERIES, CORE_SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_query_equals_sql(spark, tables, name):
    got = CORE_QUERIES[name](spark, DATA).toPandas()
    want = tables.execute(CORE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [sorted(df[cols].astype(str).replace({"None": "nan", "<NA>": "nan"}).itertuples(index=False, name=None)) for df in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(CORE_QUERIES) - set(CORE_SQL)))
def test_other_queries_run(spark, name):
    assert CORE_QUERIES[name](spark, DATA).count() >= 0


ODD = [
    (1, "The same text.", "en", "a"), (2, "The same text.", "en", "b"), (2, "The same text.", "en", "b"), (3, None, "en", "a"), (4, None, None, None), (5, "", "de", "a"),
    (6, " \t\n ", "fr", "b"), (7, "a" * 5000 + " end", "en", "a"), (8, "\ufeffmark\r\nline", "en", None), (9, "日本語のテキスト", "ja", "b"), (10, "Größe é e\u0301 ﬁ", "de", "a"), (11, "bell\x07", "en", "b"),
]
FULL = (
    "audit_per_source", "exact_duplicates", "first_occurrence", "quota_cut", "dataset_fingerprint", "split_fingerprint", "doc_identity", "split_counts", "policy_verdict",
    "rejection_counts", "quality_counts", "manifest_events", "manifest_documents", "null_accounting", "pack_windows", "pack_spans", "pack_window_ids", "pack_accounting",
    "utf8_truncate", "repeated_contents", "length_distribution", "bounded_audit", "benchmark_contained", "quota_truncations", "identity_conflicts",
)


@pytest.fixture(scope="module", params=["odd", "empty"])
def replaced(request, spark, tmp_path_factory):
    """The smallest tables with other documents: nulls, empties, repeated rows, marks; or none."""
    folder = tmp_path_factory.mktemp(request.param)
    for path in glob.glob(f"{DATA}/*.parquet"):
        if not path.endswith("/documents.parquet"):
            os.symlink(path, folder / os.path.basename(path))
    rows = [(*r, None if r[1] is None else len(r[1])) for r in ODD] if request.param == "odd" else []
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return request.param, str(folder), c


@pytest.mark.parametrize("name", FULL)
def test_odd_documents_equal_sql(spark, replaced, name):
    kind, folder, c = replaced
    got, want = CORE_QUERIES[name](spark, folder).toPandas(), c.execute(CORE_SQL[name]).df()
    if kind == "empty" and name == "pack_accounting":
        assert len(got) == len(want) == 1
        return
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


def _rows(df, cols):
    return sorted(df[cols].astype(object).where(df[cols].notna(), None).map(lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x).astype(str).itertuples(index=False, name=None))


def test_entry_stands_without_the_other_package():
    """Its import is blocked in a process of its own, as if its folder were gone."""
    import subprocess
    import sys

    code = """
import importlib.abc, sys
class Block(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tessella.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
from tessella.plans import CORE_QUERIES, CORE_SQL
assert set(e.queries()) == set(CORE_QUERIES) and set(e.oracle_sql()) == set(CORE_SQL) <= set(CORE_QUERIES)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["event_time_windows", "sliding_windows", "session_stream", "stream_pack"])
def test_streams_read_a_table_of_several_files(spark, tables, tmp_path, name):
    """Tables are folders of files where they are large."""
    for table in ("documents", "events"):
        spark.read.parquet(f"{DATA}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    got, want = CORE_QUERIES[name](spark, str(tmp_path)).toPandas(), tables.execute(CORE_SQL[name]).df()
    assert len(want) and _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


def test_odd_documents_are_packed_as_by_sql(spark, replaced):
    """Of null texts nothing is packed."""
    _, folder, c = replaced
    got, want = CORE_QUERIES["stream_pack"](spark, folder).toPandas(), c.execute(CORE_SQL["stream_pack"]).df()
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))
