"""Registered corpus queries, each with SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.measures import distribution, rate
from tessella.functions.tokens import Bytes, with_end
from tessella.operators import accounting, fixed_windows, quotas
from tessella.operators.schedule import Mix, plan, shuffle_key
from tessella.operators.totals import running_total
from tessella.runtime import table

SALT, FRACTION, WIDTH, TOTAL = "corpus-split-v1", "0.2", 1025, 200_000
MOST_BYTES = 2000
_LATIN, _JA = T.latin(), T.JAPANESE


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def identified(spark: SparkSession, d: str) -> DataFrame:
    df = documents(spark, d).withColumn("content_sha256", T.content_sha256(F.col("text")))
    sha, source, upstream = F.col("content_sha256"), F.col("source"), F.col("doc_id")
    return df.withColumns({"id_v1": T.document_id_v1(source, sha, upstream), "document_id": T.document_id_v2(source, sha, upstream), "split": T.assign_split(sha, SALT, FRACTION)})


def doc_identity(spark, d):
    return identified(spark, d).select("doc_id", "content_sha256", "id_v1", F.col("document_id").alias("id_v2"), "split")


def split_counts(spark, d):
    return identified(spark, d).groupBy("source", "split").agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct("content_sha256").alias("contents"))


def dataset_fingerprint(spark, d):
    return T.dataset_fingerprint(identified(spark, d))


def split_fingerprint(spark, d):
    return T.dataset_fingerprint(identified(spark, d), "validation")


def _judged(spark, d, policy: T.DocumentPolicy) -> DataFrame:
    return T.verdict(documents(spark, d), "text", policy)


STRICT = T.DocumentPolicy(language="ja", reject_wrong_script=True)


def policy_verdict(spark, d):
    return _judged(spark, d, T.DocumentPolicy(language="en", reject_wrong_script=True)).select("doc_id", "reason", F.length("clean").cast("long").alias("kept_chars"), "content_sha256")


def rejection_counts(spark, d):
    judged = _judged(spark, d, STRICT)
    return judged.groupBy("source", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("documents"))


def utf8_truncate(spark, d):
    cut = T.truncate_utf8(F.col("text"), MOST_BYTES)
    return documents(spark, d).select("doc_id", F.octet_length(cut).alias("kept_bytes"), F.md5(cut).alias("kept_md5"))


def script_counts(spark, d):
    return documents(spark, d).select("doc_id", T.script_counts(F.col("text")).alias("s")).select("doc_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("latin", "japanese", "other")], T.classify_language(F.col("s.japanese"), F.col("s.latin"), F.col("s.other")).alias("language"))


def exact_duplicates(spark, d):
    df = documents(spark, d).select("doc_id", "source", T.content_sha256(F.col("text")).alias("sha"))
    return accounting.summed(df, "sha", "source", "doc_id", {})


def first_occurrence(spark, d):
    """The least id of each content; rows are reduced on the map side."""
    return documents(spark, d).groupBy(T.content_sha256(F.col("text")).alias("sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sha")


def audit_per_source(spark, d):
    df = documents(spark, d).select("doc_id", "source", "text", T.content_sha256(F.col("text")).alias("sha"), T.script_counts(F.col("text")).alias("scripts"))
    df = df.withColumn("language", T.classify_language(F.col("scripts.japanese"), F.col("scripts.latin"), F.col("scripts.other")))
    return accounting.audit(df, "source", "text", "sha", "doc_id", Bytes().count(F.col("text"))).drop("truncated")


def length_distribution(spark, d):
    return documents(spark, d).withColumn("n", F.octet_length("text")).groupBy("source").agg(*distribution("n"))


def interpolated_quantiles(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.round(F.expr(f"percentile(l_extendedprice, {q})"), 4).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)])


def null_accounting(spark, d):
    df = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return accounting.null_accounting(df, ["text", "source", "quality", "toxic"])


def disjoint_ids(spark, d):
    df = identified(spark, d)
    return accounting.overlap(df.where("split = 'train'"), df.where("split = 'validation'"), "document_id")


def repeated_contents(spark, d):
    return accounting.repeated(documents(spark, d).withColumn("sha", T.content_sha256(F.col("text"))), "sha")


def index_differences(spark, d):
    """Documents against an index that holds the labelled ones, with sizes in bytes where the table has characters."""
    a = documents(spark, d).select("doc_id", "source", "n_chars")
    labelled = table(spark, d, "labels").select("doc_id").distinct()
    b = documents(spark, d).join(labelled, "doc_id", "left_semi").select("doc_id", "source", F.octet_length("text").cast("long").alias("n_chars"))
    return accounting.differences(a, b, "doc_id", ["source", "n_chars"])


def benchmark_exact_screen(spark, d):
    """Documents that are a benchmark text, by identity of content."""
    bench = table(spark, d, "benchmark").select(T.content_sha256(F.col("text")).alias("sha")).distinct()
    docs = documents(spark, d).select("doc_id", T.content_sha256(F.col("text")).alias("sha"))
    lines = documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.content_sha256(F.col("line")).alias("sha"))
    return docs.unionByName(lines).join(bench, "sha", "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"))


def _lengths(spark, d) -> DataFrame:
    """A row a document; one without a text has its end alone."""
    return documents(spark, d).select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("n_tokens"))


def _ratios(spark, d) -> DataFrame:
    sums = _lengths(spark, d).groupBy(F.col("source").alias("name")).agg(F.sum("n_tokens").alias("n"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sums.withColumn("ratio", F.col("n") / F.sum("n").over(everything))  # one row a source


def quota_largest_remainder(spark, d):
    return quotas.largest_remainder(_ratios(spark, d), TOTAL).select("name", "quota")


def quota_cut(spark, d):
    q = quotas.largest_remainder(_ratios(spark, d), TOTAL).select("name", "quota")
    df = _lengths(spark, d).join(q, F.col("source").eqNullSafe(F.col("name")))
    return quotas.cut_to_quota(df, "source", "doc_id", "n_tokens", "quota").select("source", "doc_id", "kept")


def _placed(spark, d) -> DataFrame:
    return running_total(_lengths(spark, d), "n_tokens", ["doc_id", "n_tokens"], "start")


def pack_windows(spark, d):
    df = fixed_windows.touched(_placed(spark, d), "start", "n_tokens", WIDTH)
    return df.groupBy("window_id").agg(F.sum("targets").alias("targets"), F.countDistinct("source").alias("sources"), F.count("*").alias("documents"))


def pack_source_targets(spark, d):
    df = fixed_windows.touched(_placed(spark, d), "start", "n_tokens", WIDTH)
    return df.groupBy("window_id", "source").agg(F.sum("targets").alias("targets"))


def pack_accounting(spark, d):
    total = F.sum("n_tokens")
    return _lengths(spark, d).agg(total.alias("tokens"), F.floor((total - 1) / (WIDTH - 1)).alias("full_windows"), F.pmod(total - 1, F.lit(WIDTH - 1)).alias("tail_targets"), (F.floor((total - 1) / (WIDTH - 1)) * WIDTH).alias("window_tokens"))


def pack_spans(spark, d):
    total = _lengths(spark, d).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    full, _ = fixed_windows.full_windows(total, WIDTH)
    return fixed_windows.spans(_placed(spark, d), "start", "n_tokens", WIDTH, full).select("window_id", "doc_id", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


def pack_window_ids(spark, d):
    """The windows themselves, as the sums of their inputs and of their labels.

    Places are found on lengths; texts meet them by id, hash and number among equal rows.
    """
    th = F.xxhash64("text")
    copy = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("th"))
    ids = with_end(Bytes().encode(F.coalesce("text", F.lit(""))))
    rows = documents(spark, d).select("doc_id", "text", th.alias("th"))
    places = rows.select("doc_id", "th", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("n_tokens")).withColumn("copy", copy)
    places = running_total(places, "n_tokens", ["doc_id", "n_tokens", "th", "copy"], "start").select(F.col("doc_id").alias("id"), F.col("th").alias("h"), F.col("copy").alias("c"), "start")
    total = _lengths(spark, d).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    full, _ = fixed_windows.full_windows(total, WIDTH)
    docs = rows.withColumn("copy", copy).join(places, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")) & (F.col("copy") == F.col("c"))).select("doc_id", "start", ids.alias("ids"))
    windows = fixed_windows.window_ids(docs, "start", "ids", WIDTH, full)
    inputs, labels = fixed_windows.inputs_and_labels(F.col("input_ids"))
    total_of = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, i: s + i)
    return windows.select("window_id", F.size("input_ids").cast("long").alias("n"), total_of(inputs).alias("input_sum"), total_of(labels).alias("label_sum"))


def inputs_labels_shift(spark, d):
    """Overlapping windows of conversations: inputs and labels one byte apart."""
    rows = table(spark, d, "conversations")
    rows = rows.select("conv_id", "turn", Bytes().encode(F.col("text")).alias("ids"))
    pairs = F.explode(fixed_windows.stride_one(F.col("ids"), 16)).alias("p")
    return rows.select("conv_id", "turn", pairs).groupBy("conv_id", "turn").agg(F.count("*").alias("windows"), F.sum(F.col("p.inputs")[0]).alias("first_inputs"), F.sum(F.col("p.labels")[15]).alias("last_labels"))


def ratio_tolerance(spark, d):
    counts = pack_source_targets(spark, d).groupBy(F.col("source").alias("name")).agg(F.sum("targets").alias("targets"))
    out = quotas.ratio_report(counts, _ratios(spark, d).select("name", "ratio"), "name", "targets", 0.001)
    return out.select("name", "targets", F.round("deviation", 6).alias("deviation"), "within")


def rates(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("lang") == "de").alias("german")).select("source", rate(F.col("chars"), F.col("n")).alias("chars_per_document"), rate(F.col("chars"), F.col("german")).alias("chars_per_german"))


def _positions(spark, d) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return _lengths(spark, d).withColumn("position", F.row_number().over(w) - 1)


def _mixture(spark, d) -> tuple[dict[str, float], int]:
    """Ratios of all sources, 3 to 1 to 2 in turn, and half of the tokens they can supply in these: one row a source comes to the driver."""
    rows = _lengths(spark, d).groupBy("source").agg(F.sum("n_tokens").alias("n")).orderBy("source").collect()
    weights = {r.source: (3, 1, 2)[i % 3] for i, r in enumerate(rows)}
    ratios = {s: w / sum(weights.values()) for s, w in weights.items()}
    return ratios, int(min(r.n / ratios[r.source] for r in rows) / 2)


def mix_weighted(spark, d):
    ratios, total = _mixture(spark, d)
    return plan(_positions(spark, d), Mix(ratios, seed=17, quotas=quotas.largest_remainder_of(ratios, total)))


def mix_debt(spark, d):
    ratios, total = _mixture(spark, d)
    return plan(_positions(spark, d), Mix(ratios, seed=17, targets=quotas.largest_remainder_of(ratios, total), width=129, by_debt=True))


def mix_buffered(spark, d):
    ratios, total = _mixture(spark, d)
    return plan(_positions(spark, d), Mix(ratios, seed=17, quotas=quotas.largest_remainder_of(ratios, total), buffer=8))


def hash_shuffle(spark, d):
    """Every document's place in a seeded global order."""
    keyed = documents(spark, d).select("doc_id", shuffle_key(17, "doc_id").alias("k"), F.lit(1).cast("long").alias("one"))
    return running_total(keyed, "one", ["k", "doc_id"], "place").select("doc_id", "place")


QUERIES = {
    f.__name__: f
    for f in (
        split_counts, doc_identity, dataset_fingerprint, split_fingerprint, policy_verdict, rejection_counts, utf8_truncate, script_counts, exact_duplicates,
        first_occurrence, audit_per_source, length_distribution, interpolated_quantiles, null_accounting, disjoint_ids, repeated_contents, index_differences,
        benchmark_exact_screen, quota_largest_remainder, quota_cut, pack_windows, pack_source_targets, pack_accounting, pack_spans, pack_window_ids,
        inputs_labels_shift, ratio_tolerance, rates, mix_weighted, mix_debt, mix_buffered, hash_shuffle,
    )
}

_BLANK = T.BLANK
_NORM = rf"regexp_replace(regexp_replace(nfc_normalize(replace(replace(CASE WHEN starts_with(text, chr(65279)) THEN substring(text, 2) ELSE text END, chr(13) || chr(10), chr(10)), chr(13), chr(10))), '^{_BLANK}+', ''), '{_BLANK}+$', '')"
_SHA = f"sha256({_NORM})"
# A policy keeps a byte-order mark in the text; its identity leaves it out.
_CLEAN = rf"regexp_replace(regexp_replace(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), '^{_BLANK}+', ''), '{_BLANK}+$', '')"
_CLEAN_SHA = rf"sha256(regexp_replace(regexp_replace(CASE WHEN starts_with(t, chr(65279)) THEN substring(t, 2) ELSE t END, '^{_BLANK}+', ''), '{_BLANK}+$', ''))"
_RANK = f"row_number() OVER (PARTITION BY {_SHA} ORDER BY doc_id NULLS FIRST, source NULLS FIRST)"
_UPSTREAM = """CASE WHEN doc_id IS NULL THEN '' ELSE ',"upstream_id":"' || doc_id || '"' END"""
_IDS = f"""SELECT *, CASE WHEN doc_id IS NULL THEN sha256('{{"content_sha256":"' || sha || '","source_identity":"' || source || '"}}') WHEN sha IS NOT NULL THEN sha256('{{"source_identity":"' || source || '","upstream_id":"' || doc_id || '"}}') END AS id_v1,
  sha256('{{"content_sha256":"' || sha || '","source_identity":"' || source || '"' || {_UPSTREAM} || '}}') AS id_v2,
  CASE WHEN sha IS NULL THEN NULL WHEN substr(sha256('{SALT}' || chr(0) || sha), 1, 16) < '{T.validation_threshold(FRACTION)}' THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, {_SHA} AS sha FROM documents)"""
_SCRIPTS = rf"""length(regexp_replace(text, '[^{_LATIN}]', '', 'g')) AS latin, length(regexp_replace(text, '[^{_JA}]', '', 'g')) AS japanese,
  length(regexp_replace(regexp_replace(text, '[{_JA}{_LATIN}]', '', 'g'), '[^\p{{L}}]', '', 'g')) AS other"""
_LANG = "CASE WHEN japanese > 0 AND latin > 0 THEN 'mixed' WHEN japanese > 0 THEN 'ja' WHEN latin > 0 THEN 'en' ELSE 'other' END"
_LEN = "SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS n FROM documents"
_QUOTA = f"""SELECT name, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, name DESC) <= {TOTAL} - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota
  FROM (SELECT name, floor({TOTAL}.0::DOUBLE * ratio) AS f, {TOTAL}.0::DOUBLE * ratio - floor({TOTAL}.0::DOUBLE * ratio) AS r
    FROM (SELECT source AS name, sum(n)::DOUBLE / sum(sum(n)) OVER () AS ratio FROM ({_LEN}) GROUP BY source))"""
_TOUCH = f"""SELECT *, least(e, (k + 1) * {WIDTH - 1} + 1) - greatest(s, k * {WIDTH - 1} + 1) AS targets FROM (
  SELECT *, unnest(range((s - 1) // {WIDTH - 1}, (e - 2) // {WIDTH - 1} + 1)) AS k FROM (
    SELECT *, greatest(start, 1) AS s, start + n AS e FROM (SELECT *, (sum(n) OVER (ORDER BY doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start FROM ({_LEN}))) WHERE e > s)"""

SQL = {
    "doc_identity": f"SELECT doc_id, sha AS content_sha256, id_v1, id_v2, split FROM ({_IDS})",
    "split_counts": f"SELECT source, split, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha) AS contents FROM ({_IDS}) GROUP BY source, split",
    "dataset_fingerprint": f"""SELECT sha256('{{"documents":[' || coalesce(string_agg('{{"content_sha256":"' || sha || '","document_id":"' || id_v2 || '","split":"' || split || '"}}', ',' ORDER BY id_v2, sha, split), '') || ']}}') AS fingerprint FROM ({_IDS}) WHERE id_v2 IS NOT NULL""",
    "split_fingerprint": f"""SELECT sha256('{{"documents":[' || coalesce(string_agg('{{"content_sha256":"' || sha || '","document_id":"' || id_v2 || '"}}', ',' ORDER BY id_v2, sha), '') || '],"split":"validation"}}') AS fingerprint FROM ({_IDS}) WHERE split = 'validation'""",
    "policy_verdict": rf"""SELECT doc_id, reason, CASE WHEN reason IS NULL THEN length(t) END AS kept_chars, CASE WHEN reason IS NULL THEN {_CLEAN_SHA} END AS content_sha256 FROM (
      SELECT doc_id, t, CASE WHEN t IS NULL THEN 'non_string' WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '{T.CONTROL}') THEN 'control_character'
        WHEN regexp_matches(t, '[{_JA}]') AND NOT regexp_matches(t, '[{_LATIN}]') THEN 'wrong_script' END AS reason FROM (SELECT doc_id, {_CLEAN} AS t FROM documents))""",
    "rejection_counts": rf"""SELECT source, CASE WHEN t IS NULL THEN 'non_string' WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '{T.CONTROL}') THEN 'control_character'
      WHEN NOT regexp_matches(t, '[{_JA}]') THEN 'wrong_script' ELSE 'accepted' END AS reason, count(*) AS documents FROM (SELECT source, {_CLEAN} AS t FROM documents) GROUP BY 1, 2""",
    "script_counts": f"SELECT *, {_LANG} AS language FROM (SELECT doc_id, {_SCRIPTS} FROM documents)",
    "exact_duplicates": f"SELECT source, count(*) AS documents, count(*) FILTER (k > 1) AS duplicates FROM (SELECT source, {_RANK} AS k FROM documents) GROUP BY source",
    "first_occurrence": f"SELECT min(doc_id) AS doc_id, sha FROM (SELECT doc_id, {_SHA} AS sha FROM documents) GROUP BY sha",
    "audit_per_source": f"""SELECT source, count(*) AS documents, sum(strlen(text))::BIGINT AS text_bytes, sum(strlen(text))::BIGINT AS tokens, count(*) AS end_tokens, sum(latin)::BIGINT AS latin, sum(japanese)::BIGINT AS japanese, sum(other)::BIGINT AS other,
      count(*) FILTER (language = 'en') AS lang_en, count(*) FILTER (language = 'ja') AS lang_ja, count(*) FILTER (language = 'mixed') AS lang_mixed, count(*) FILTER (language = 'other') AS lang_other, count(*) FILTER (k > 1) AS duplicates
      FROM (SELECT *, {_LANG} AS language FROM (SELECT *, {_SCRIPTS}, {_RANK} AS k FROM documents)) GROUP BY source""",
    "length_distribution": "SELECT source, count(n) AS count, quantile_disc(n, 0.5)::DOUBLE AS p50, quantile_disc(n, 0.95)::DOUBLE AS p95, quantile_disc(n, 0.99)::DOUBLE AS p99, max(n) AS max FROM (SELECT source, strlen(text)::INT AS n FROM documents) GROUP BY source",
    "interpolated_quantiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS q5, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY l_returnflag",
    "null_accounting": " UNION ALL ".join(f"SELECT 'null:{c}' AS reason, count(*) FILTER ({c} IS NULL) AS events FROM documents LEFT JOIN labels USING (doc_id)" for c in ("text", "source", "quality", "toxic")),
    "disjoint_ids": f"SELECT DISTINCT id_v2 AS document_id FROM ({_IDS}) WHERE split = 'train' AND id_v2 IN (SELECT id_v2 FROM ({_IDS}) WHERE split = 'validation')",
    "repeated_contents": f"SELECT sha, count(*) AS n FROM (SELECT {_SHA} AS sha FROM documents) GROUP BY sha HAVING count(*) > 1",
    "index_differences": "SELECT doc_id, true AS in_source, doc_id IN (SELECT doc_id FROM labels) AS in_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR n_chars != strlen(text)",
    "benchmark_exact_screen": f"""WITH b AS (SELECT DISTINCT {_SHA} AS sha FROM benchmark),
      x AS (SELECT doc_id, {_SHA} AS sha FROM documents UNION ALL SELECT doc_id, {_SHA} AS sha FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents))
      SELECT doc_id, count(*) AS hits FROM x WHERE sha IN (SELECT sha FROM b) GROUP BY doc_id""",
    "quota_largest_remainder": _QUOTA,
    "quota_cut": f"""SELECT source, doc_id, kept::BIGINT AS kept FROM (SELECT d.source, doc_id, least(n, quota - (sum(n) OVER (PARTITION BY d.source ORDER BY doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) - n)) AS kept FROM ({_LEN}) d JOIN ({_QUOTA}) q ON q.name IS NOT DISTINCT FROM d.source) WHERE kept > 0""",
    "pack_windows": f"SELECT k AS window_id, sum(targets)::BIGINT AS targets, count(DISTINCT source) AS sources, count(*) AS documents FROM ({_TOUCH}) GROUP BY k",
    "pack_source_targets": f"SELECT k AS window_id, source, sum(targets)::BIGINT AS targets FROM ({_TOUCH}) GROUP BY k, source",
    "pack_accounting": f"SELECT t AS tokens, (t - 1) // {WIDTH - 1} AS full_windows, (t - 1) % {WIDTH - 1} AS tail_targets, (t - 1) // {WIDTH - 1} * {WIDTH} AS window_tokens FROM (SELECT sum(n)::BIGINT AS t FROM ({_LEN}))",
    "pack_spans": f"""WITH p AS (SELECT *, (sum(n) OVER (ORDER BY doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start FROM ({_LEN})), t AS (SELECT (sum(n)::BIGINT - 1) // {WIDTH - 1} AS f FROM p)
      SELECT w AS window_id, doc_id, greatest(start - w * {WIDTH - 1}, 0) AS span_start, least(start + n - w * {WIDTH - 1}, {WIDTH}) AS span_end
      FROM (SELECT p.*, f, unnest(range(greatest(0, (start - 1) // {WIDTH - 1} - 1), (start + n) // {WIDTH - 1} + 1)) AS w FROM p, t) WHERE w < f AND least(start + n - w * {WIDTH - 1}, {WIDTH}) > greatest(start - w * {WIDTH - 1}, 0)""",
    "ratio_tolerance": f"""SELECT name, targets, round(abs(targets / sum(targets) OVER () - ratio), 6) AS deviation, abs(targets / sum(targets) OVER () - ratio) <= 0.001 AS within FROM (
      SELECT source AS name, sum(targets)::BIGINT AS targets FROM ({_TOUCH}) GROUP BY source) JOIN (SELECT source AS name, sum(n)::DOUBLE / sum(sum(n)) OVER () AS ratio FROM ({_LEN}) GROUP BY source) USING (name)""",
    "rates": "SELECT source, round(sum(n_chars) / count(*), 6) AS chars_per_document, round(sum(n_chars) / nullif(count(*) FILTER (lang = 'de'), 0), 6) AS chars_per_german FROM documents GROUP BY source",
    "utf8_truncate": f"""SELECT doc_id, strlen(cut) AS kept_bytes, md5(cut) AS kept_md5 FROM (SELECT doc_id, CASE WHEN strlen(text) <= {MOST_BYTES} THEN text
      ELSE left(text, list_max(list_filter(range({MOST_BYTES // 4}, {MOST_BYTES} + 1), lambda i: strlen(left(text, i)) <= {MOST_BYTES}))) END AS cut FROM documents)""",
    "pack_window_ids": f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, n, (sum(n) OVER (ORDER BY doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start FROM (SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS n FROM documents)),
      f AS (SELECT (sum(n)::BIGINT - 1) // {WIDTH - 1} AS w FROM d),
      t AS (SELECT start + i AS p, ('0x' || x)::INT + 8 AS id FROM (SELECT start, unnest(regexp_extract_all(h, '..')) AS x, unnest(range(0, n - 1)) AS i FROM d) UNION ALL SELECT start + n - 1, 7 FROM d),
      a AS (SELECT p // {WIDTH - 1} AS k, sum(id)::BIGINT AS s FROM t GROUP BY 1), b AS (SELECT (p - 1) // {WIDTH - 1} AS k, sum(id)::BIGINT AS s FROM t WHERE p > 0 GROUP BY 1)
      SELECT a.k AS window_id, {WIDTH}::BIGINT AS n, a.s AS input_sum, b.s AS label_sum FROM a JOIN b USING (k) WHERE a.k < (SELECT w FROM f)""",
    "hash_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY md5('17:' || doc_id) NULLS FIRST, doc_id) - 1 AS place FROM documents",
    "inputs_labels_shift": r"""SELECT conv_id, turn, count(*) AS windows, sum(a)::BIGINT AS first_inputs, sum(b)::BIGINT AS last_labels FROM (
      SELECT conv_id, turn, ('0x' || substr(h, i * 2 + 1, 2))::INT + 8 AS a, ('0x' || substr(h, (i + 16) * 2 + 1, 2))::INT + 8 AS b
      FROM (SELECT conv_id, turn, hex(encode(text)) AS h, unnest(range(0, strlen(text) - 16)) AS i FROM conversations)) GROUP BY conv_id, turn""",
}
