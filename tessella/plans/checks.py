"""Registered queries of checks, manifests, windows and small operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import measures as M
from tessella.functions import text as T
from tessella.functions.tokens import END, Bytes, byte_fallbacks, with_end
from tessella.operators import accounting, checks, fixed_windows, quotas
from tessella.operators import evidence as E
from tessella.operators import runs as R
from tessella.operators import selection as S
from tessella.operators.totals import running_total
from tessella.plans import corpus
from tessella.plans.evidence import events
from tessella.runtime import table
from tessella.sources import manifests
from tessella.sources.readers import key_values, separated

POLICY = {"language": "en", "max_utf8_bytes": 1500, "reject_controls": True, "reject_wrong_script": True, "version": 1}
QUOTA, BUDGET = 900, 100_000


def lazy_manifest() -> dict:
    """A manifest of the table ``documents`` as one remote Parquet file."""
    m = {
        "document_policy": dict(POLICY), "name": "documents", "purpose": "pretraining", "schema_version": 2,
        "source": {"config_name": "c", "data_files": [{"path": "documents.parquet", "sha256": "0" * 64, "size_bytes": 0}], "id_field": "doc_id", "kind": "hf_parquet", "metadata_fields": ["lang", "source"], "repo_id": "r", "revision": "0" * 40, "split": "train", "text_field": "text"},
        "split": {"method": manifests.SPLIT_METHOD, "salt": corpus.SALT, "validation_fraction": corpus.FRACTION}, "usage": {"license": "l", "terms_url": "u"},
    }
    m["dataset_fingerprint"] = manifests.dataset_fingerprint_of(m)
    m["manifest_fingerprint"] = manifests.fingerprint(m)
    return m


def _scan(spark, d):
    return manifests.scan(spark, manifests.Resolved(lazy_manifest(), "train", None, None), [f"{d}/documents.parquet"])


def manifest_events(spark, d):
    """Rows, accepted documents, refusals by reason, the other split, and null cells of a lazy manifest's scan."""
    return accounting.event_counts(_scan(spark, d), "reason", ["text", "lang", "source", "doc_id"])


def manifest_documents(spark, d):
    df = _scan(spark, d).where("reason IS NULL")
    return df.select("doc_id", "document_id", "content_sha256", "truncated", "fallback_id", F.octet_length("clean").cast("long").alias("bytes"))


def quality_counts(spark, d):
    df = T.verdict(corpus.documents(spark, d), "text", T.DocumentPolicy(**POLICY))
    first = F.col("doc_id") != F.col("first")
    kept = df.where("content_sha256 IS NOT NULL").groupBy(F.col("content_sha256").alias("k")).agg(F.min("doc_id").alias("first"))
    df = df.select("doc_id", "source", "reason", "truncated", "content_sha256").join(kept, F.col("content_sha256") == F.col("k"), "left")
    return checks.quality_counts(df, "source", "reason", "truncated", F.coalesce(first, F.lit(False)))


def bounded_audit(spark, d):
    df = corpus.documents(spark, d).select(F.md5(F.col("doc_id").cast("string")).alias("emit"), "doc_id", "source", F.octet_length("text").alias("n"))
    return checks.bounded(df, ["emit", "doc_id"], 100).groupBy("source", "bounded").agg(F.count("*").alias("documents"), F.sum("n").alias("bytes"))


def _total(spark, d) -> int:
    return corpus._lengths(spark, d).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]


def pack_keep_tail(spark, d):
    return fixed_windows.layout(spark, _total(spark, d), corpus.WIDTH, keep_tail=True)


def pack_budget_cut(spark, d):
    total = _total(spark, d)
    return fixed_windows.layout(spark, total, corpus.WIDTH, budget=min(BUDGET, max(0, total - 1) // 2))


def target_alignment(spark, d):
    """The source of every target of every full window, counted: from the windows' spans."""
    full, _ = fixed_windows.full_windows(_total(spark, d), corpus.WIDTH)
    spans = fixed_windows.spans(corpus._placed(spark, d), "start", "n_tokens", corpus.WIDTH, full)
    packed = spans.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), "source"))).alias("spans"))
    rows = packed.select("window_id", F.explode(fixed_windows.target_sources(F.col("spans"))).alias("source"))
    return rows.groupBy("window_id", "source").agg(F.count("*").alias("targets"))


def quota_cut_texts(spark, d):
    """Conversation turns cut to a quota of byte tokens: ids kept, and the text that they decode to."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", with_end(Bytes().encode(F.col("text"))).alias("ids"))
    ids = quotas.cut_ids(F.col("ids"), F.lit(64), END)
    return rows.select("conv_id", "turn", F.size(ids).cast("long").alias("kept"), F.element_at(ids, -1).alias("last"), F.md5(quotas.cut_bytes(F.col("text"), F.lit(64))).alias("text_md5"))


def quota_truncations(spark, d):
    df = corpus._lengths(spark, d).withColumn("kept", F.least("n_tokens", F.lit(QUOTA)))
    return quotas.truncation_counts(df, "source", "n_tokens", "kept")


def token_round_trips(spark, d):
    """Every turn comes back from its ids; pieces of line ends count as byte pieces."""
    rows = table(spark, d, "conversations").withColumn("ids", Bytes().encode(F.col("text")))
    rows = rows.withColumns({"back": Bytes().decode(F.col("ids")), "pieces": F.transform("ids", lambda i: F.when(i == 18, F.lit("<0x0A>")).otherwise("x")), "key": F.col("conv_id") * 1000 + F.col("turn")})
    out = R.round_trips(rows, ["role"], "text", "back", "key", F.lit(0), byte_fallbacks(F.col("pieces")))
    return out.select("role", "texts", "failures", "unknown", "fallbacks")


def memorisation_stream(spark, d):
    out = checks.token_stream(table(spark, d, "conversations"), ["conv_id"], ["turn"], Bytes().encode(F.col("text")), END)
    return out.select("conv_id", F.size("ids").cast("long").alias("tokens"), F.md5(F.array_join("ids", ",")).alias("stream_md5"))


def framed_digests(spark, d):
    return checks.framed_digest(table(spark, d, "conversations"), "conv_id", ["turn"], ["role", "text"])


def identity_conflicts(spark, d):
    return checks.identity_conflicts(corpus.documents(spark, d), "source", F.col("lang"))


def strata_counts(spark, d):
    expected = table(spark, d, "labels").join(corpus.documents(spark, d), "doc_id").groupBy("lang").agg(F.count("*").alias("expected"))
    return checks.strata(corpus.documents(spark, d), "lang", "doc_id", expected)


def arm_changes(spark, d):
    out = checks.arms(events(spark, d), "user_id", "event_type", "value", "click", "view")
    return out.select("user_id", *[F.round(c, 4).alias(c) for c in ("base", "other", "change_percent")])


def first_and_steady(spark, d):
    out = checks.first_and_steady(events(spark, d), ["user_id"], ["ts", "event_id"], "value")
    return out.select("user_id", "first", "steady", F.round("steady_mean", 6).alias("steady_mean"), "steady_max")


def record_counts(spark, d):
    return checks.record_counts(events(spark, d), "event_type", "user_id", "event_id")


def cache_identity(spark, d):
    return checks.cache_identity(table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("shard-"), "s_suppkey").alias("path"), F.col("s_nationkey").cast("long").alias("size_bytes")))


def ordered_fingerprints(spark, d):
    df = table(spark, d, "nation").select((F.col("n_regionkey") > 1).cast("int").alias("side"), F.col("n_nationkey").alias("place"), F.sha2("n_name", 256).alias("sha"))
    return checks.ordered_fingerprint(df, ["side", "place"], "sha")


def run_rows(spark, d):
    steps = corpus_steps(spark, d)
    out = checks.run_summary(steps, "user_id", "step", "wall", "tokens", "loss", "pause", warmup=2)
    return out.select("user_id", "steps", "tokens", *[F.round(c, 6).alias(c) for c in ("pause_seconds", "step_median", "step_p95", "step_max", "first_loss", "last_loss", "tokens_per_second")], "finite", "complete", "passed")


def corpus_steps(spark, d):
    """Events as the steps of a run for each user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select("user_id", F.row_number().over(w).alias("step"), (F.col("value") + 1).alias("wall"), (F.col("event_id") % 7).alias("tokens"), F.col("value").alias("loss"), F.when(F.col("event_type") == "view", 0.5).otherwise(0.0).alias("pause"))


def pilot_gates(spark, d):
    out = checks.run_summary(corpus_steps(spark, d), "user_id", "step", "wall", "tokens", "loss", "pause", warmup=2)
    named = {"training_gates": F.col("passed"), "long_enough": F.col("steps") >= 5, "pause_observed": F.col("pause_seconds") > 0, "loss_fell": F.col("last_loss") < F.col("first_loss")}
    return checks.pilot_gates(out, "user_id", named)


def plan_problems(spark, d):
    planned = events(spark, d).where("event_id % 3 != 0").select(F.col("user_id").alias("candidate"), (F.col("event_id") % 3).alias("repetition"))
    made = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("repetition"))
    return checks.plan_problems(planned, made, ["candidate", "repetition"])


def log_cadence(spark, d):
    logs = corpus_steps(spark, d).withColumn("last", F.lit(40)).where("step % 10 = 0 AND step <= 40 OR step = 15 AND user_id % 5 = 0")
    return checks.off_cadence(logs, ["user_id"], "step", 10, "last")


def proc_counters(spark, d):
    lines = events(spark, d).select(F.concat_ws("", F.initcap("event_type"), F.lit(":   "), F.col("event_id"), F.when(F.col("event_id") % 2 == 0, F.lit(" kB")).otherwise(F.lit(""))).alias("value"))
    return key_values(lines).groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("lines"))


def device_lines(spark, d):
    number = F.when(F.col("event_id") % 5 == 0, "[N/A]").otherwise(F.col("event_id").cast("string"))
    lines = events(spark, d).select(F.concat_ws(", ", F.col("user_id").cast("string"), number, F.col("event_type")).alias("value"))
    return separated(lines, ["device", "power", "state"], ",", numbers=("power",)).groupBy("device").agg(F.sum("power").alias("power"), F.count("power").alias("values"), F.count("*").alias("lines"))


def top_k_retained(spark, d):
    return accounting.latest(events(spark, d), ["user_id"], "event_id", 3).select("user_id", "event_id")


def eviction_victim(spark, d):
    shards = events(spark, d).select(F.col("event_id").cast("string").alias("path"), F.col("value").alias("used_at"), (F.col("event_type") == "click").alias("leased"))
    return R.eviction_victim(shards).select("path", "used_at")


def counter_merge(spark, d):
    a = corpus.documents(spark, d).groupBy("source").agg(F.count("*").alias("documents"))
    b = corpus.documents(spark, d).join(table(spark, d, "labels"), "doc_id").where("quality = 1").groupBy("source").agg(F.count("*").alias("good"))
    return accounting.merge_counters(a, b, "source", ["documents"], ["good"])


def lineage_breaks(spark, d):
    e = events(spark, d)
    segments = e.select(F.col("event_id").alias("segment"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("b"), (F.col("event_id") - F.col("event_id") % 3))).alias("parent"), (F.col("event_id") % 4).alias("start_step"))
    bounds = e.where("event_id % 3 = 0 AND event_id % 2 = 0").select(F.concat(F.lit("b"), "event_id").alias("boundary"), F.col("event_id").alias("segment"), (F.col("event_id") % 4).alias("step"))
    return R.lineage_breaks(segments, bounds)


def phase_sums(spark, d):
    df = events(spark, d).withColumn("phases", F.create_map(F.col("event_type"), F.col("value"), F.lit("all"), F.lit(1.0)))
    return E.phase_sums(df, ["user_id"], "phases").select("user_id", "phase", F.round("seconds", 4).alias("seconds"))


def unexplained_time(spark, d):
    df = events(spark, d).withColumn("phases", F.create_map(F.lit("a"), F.col("value") / 2, F.lit("b"), F.col("value") / 4))
    left = E.unexplained(F.col("value"), F.col("phases"), F.lit(0.5))
    return df.select("event_id", F.round(left, 6).alias("unexplained"), E.has_phases(F.col("phases"), ["a", "b"]).alias("has_phases"))


def lifecycle(spark, d):
    df = events(spark, d).select("user_id", F.col("event_type").alias("action"), F.when(F.col("value") > 50, "failed").otherwise("ok").alias("outcome"))
    return E.lifecycle(df, ["user_id"], [("click", "ok"), ("view", "ok")], [("purchase", "failed")])


def disagreements(spark, d):
    df = table(spark, d, "customer").select("c_mktsegment", F.lit("same").alias("image"), (F.col("c_custkey") >= 0).alias("positive"))
    return E.disagreements(df, ["c_mktsegment", "image", "positive"]).withColumn("values", F.col("values").cast("long"))


def fold_verdict(spark, d):
    df = events(spark, d).select("user_id", (F.col("value") < 0).alias("failed"), (F.col("value") > 50).alias("warned"))
    return E.verdict(df, "failed", "warned")


def histogram_checks(spark, d):
    df = events(spark, d).groupBy("user_id").agg(F.count_if(F.col("value") < 10).alias("a"), F.count_if(F.col("value") >= 10).alias("b"))
    counts = F.array(F.col("a").cast("double"), F.col("b").cast("double"))
    edges = F.when(F.col("user_id") % 2 == 0, F.array(F.lit(0.0), F.lit(10.0), F.lit(1e9))).otherwise(F.array(F.lit(10.0), F.lit(0.0), F.lit(1e9)))
    return df.select("user_id", E.valid_histogram(counts, edges).alias("valid"))


def file_changes(spark, d):
    listed = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.sha2("s_name", 256).alias("sha256")).where("s_suppkey % 5 != 0")
    actual = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.sha2(F.when(F.col("s_suppkey") % 7 == 0, "x").otherwise(F.col("s_name")), 256).alias("sha256")).where("s_suppkey % 11 != 0")
    return E.inventory_problems(listed, actual)


def resource_rates(spark, d):
    e = events(spark, d).groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b"))
    before = e.select("user_id", F.lit(0.0).alias("seconds"), F.col("a.event_id").alias("reads"), F.col("b.event_id").alias("swap"))
    after = e.select("user_id", F.lit(4.0).alias("seconds"), F.col("b.event_id").alias("reads"), F.col("a.event_id").alias("swap"))
    return R.resource_rates(before, after, "user_id", "seconds", ["reads", "swap"], ["swap"])


def memory_stability(spark, d):
    edges = E.window_edges(events(spark, d), ["user_id"], ["ts", "event_id"], "value", 20)
    return R.memory_stable(edges, slack=1, share=0.05).select("user_id", "stable")


def weaker_thresholds(spark, d):
    own = table(spark, d, "nation").where("n_nationkey % 6 != 5").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * F.when(F.col("n_nationkey") % 3 == 0, 2).otherwise(1)).cast("double").alias("value"))
    kept = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 2, "floor").otherwise("ceiling").alias("kind"), (F.col("n_nationkey") + F.col("n_regionkey") % 2).cast("double").alias("value"))
    return S.weaker_thresholds(own, kept)


def online_adjustment(spark, d):
    """A pilot's slow-down against its measurement scales every candidate's speed, never up."""
    pilot = events(spark, d).where("event_type = 'purchase'").agg(F.avg("value").alias("pilot"))
    speeds = events(spark, d).groupBy("user_id").agg(F.min("value").alias("speed"), F.avg("value").alias("matrix"))
    return speeds.crossJoin(F.broadcast(pilot)).select("user_id", F.round(R.slowed(F.col("speed"), F.col("pilot"), F.col("matrix")), 6).alias("speed"))  # one row


def disk_forecast(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.lit(10_000).alias("free"), (F.col("s_suppkey") * 10).alias("managed"), (F.col("s_nationkey") * 100).alias("cap"), F.lit(50).alias("largest"))
    left = S.headroom(F.col("free"), F.col("managed"), F.col("cap"), F.col("largest"), F.lit(1000))
    return df.select("s_suppkey", left.cast("long").alias("headroom"), (left >= 0).alias("enough"), S.checkpoint_bytes(F.col("s_nationkey"), F.col("managed"), 100, F.lit(7)).cast("long").alias("run_bytes"))


def paired_regression(spark, d):
    out = checks.arms(events(spark, d), "user_id", "event_type", "value", "click", "purchase")
    return out.where("base IS NOT NULL AND other IS NOT NULL").select("user_id", F.round(M.regression_percent(F.col("base"), F.col("other")), 4).alias("regression_percent"))


def perplexities(spark, d):
    df = events(spark, d).groupBy("user_id").agg(F.sum(F.col("value") * F.when(F.col("user_id") % 4 == 0, 1000).otherwise(0.01)).alias("loss"), F.count("*").alias("targets"))
    nll, ppl, over = M.perplexity(F.col("loss"), F.col("targets"))
    return df.select("user_id", F.round(nll, 6).alias("nll"), F.round(ppl, 4).alias("perplexity"), over.alias("overflow"))


def finite_values(spark, d):
    df = events(spark, d).withColumn("x", F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")))
    return df.groupBy("user_id").agg(E.all_finite(["x"]).alias("finite"))


def sampler_coverage(spark, d):
    df = events(spark, d).withColumn("took", F.lit(100.0))
    out = R.expected_samples(df, ["user_id"], "seconds", "took", 3500.0)
    return out.select("user_id", "samples", "expected", F.round("coverage", 6).alias("coverage"))


def rejection_determinism(spark, d):
    df = events(spark, d).select("user_id", (F.col("value") > 20).alias("rejected"), F.when(F.col("value") > 20, F.col("event_type")).alias("outcome"))
    return R.deterministic(df, "user_id")


def benchmark_contained(spark, d):
    """Documents that hold a benchmark text verbatim: both sides meet by the hash of a run of words that the text must bring along, then the text itself is looked for.

    The run is the text's second to seventh word; a shorter text of three words or more has all words but its first and last.
    """
    words = lambda c: F.filter(F.split(F.col(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bench = table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("passage"))
    bench = bench.withColumn("w", words("passage")).where("size(w) >= 3").withColumn("n", F.least(F.size("w"), F.lit(8)))
    # The first word of a passage may go on to the left in a document, and its last to the right, so runs start at the second word.
    bench = bench.withColumn("run", F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("n") - 2), " "))).select("item_id", "passage", (F.col("n") - 2).alias("k"), "run")
    sizes = [r.k for r in bench.select("k").distinct().collect()]  # at most 6 numbers
    docs = corpus.documents(spark, d).select("doc_id", "text", words("text").alias("w"))

    def runs_of(k: int):
        starts = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))

    runs = F.array_distinct(F.flatten(F.array(*[runs_of(k) for k in sizes]))) if sizes else F.array().cast("array<bigint>")
    hits = docs.select("doc_id", F.explode(runs).alias("run")).join(bench.select("run", "item_id", "passage"), "run")
    texts = corpus.documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    return hits.select("doc_id", "item_id", "passage").distinct().join(texts, F.col("doc_id") == F.col("id")).where(F.col("text").contains(F.col("passage"))).groupBy("doc_id").agg(F.count_distinct("item_id").alias("items"))


def overlapping_splits(spark, d):
    """Documents of two sets that do overlap: those of the two halves of a hash that have one content."""
    df = corpus.documents(spark, d).select("doc_id", T.content_sha256(F.col("text")).alias("sha"))
    return accounting.overlap(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), "sha")


def manifest_union(spark, d):
    """Documents of two overlapping packages, each once."""
    df = corpus.documents(spark, d).select("doc_id", "source")
    return df.where("doc_id % 3 != 0").unionByName(df.where("doc_id % 3 != 1")).distinct().groupBy("source").agg(F.count("*").alias("documents"))


def first_batch(spark, d):
    """A preview of the first full window on a stream of its own: its spans."""
    rows = running_total(corpus._lengths(spark, d), "n_tokens", ["doc_id"], "start")
    return fixed_windows.spans(rows, "start", "n_tokens", corpus.WIDTH, 1).select("doc_id", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


QUERIES = {
    f.__name__: f
    for f in (
        manifest_events, manifest_documents, quality_counts, bounded_audit, pack_keep_tail, pack_budget_cut, target_alignment, quota_cut_texts, quota_truncations, token_round_trips,
        memorisation_stream, framed_digests, identity_conflicts, strata_counts, arm_changes, first_and_steady, record_counts, cache_identity, ordered_fingerprints, run_rows, pilot_gates,
        plan_problems, log_cadence, proc_counters, device_lines, top_k_retained, eviction_victim, counter_merge, lineage_breaks, phase_sums, unexplained_time, lifecycle, disagreements,
        fold_verdict, histogram_checks, file_changes, resource_rates, memory_stability, weaker_thresholds, online_adjustment, disk_forecast, paired_regression, perplexities, finite_values,
        sampler_coverage, rejection_determinism, benchmark_contained, overlapping_splits, manifest_union, first_batch,
    )
}

_SECONDS = "epoch_us(ts) / 1e6"
_KEPT = rf"""SELECT *, CASE WHEN reason IS NULL THEN sha256(regexp_replace(regexp_replace(CASE WHEN starts_with(t, chr(65279)) THEN substring(t, 2) ELSE t END, '^{T.BLANK}+', ''), '{T.BLANK}+$', '')) END AS sha FROM (
    SELECT *, CASE WHEN x IS NULL THEN 'non_string' WHEN x = '' THEN 'empty' WHEN regexp_matches(x, '{T.CONTROL}') THEN 'control_character'
      WHEN over AND t = '' THEN 'empty_after_truncation' WHEN regexp_matches(t, '[{T.JAPANESE}]') AND NOT regexp_matches(t, '[{T.latin()}]') THEN 'wrong_script' END AS reason
    FROM (SELECT *, strlen(x) > {POLICY["max_utf8_bytes"]} AS over, CASE WHEN strlen(x) > {POLICY["max_utf8_bytes"]} THEN regexp_replace(left(x, list_max(list_filter(range(0, {POLICY["max_utf8_bytes"]} + 1), lambda i: strlen(left(x, i)) <= {POLICY["max_utf8_bytes"]}))), '{T.BLANK}+$', '') ELSE x END AS t
      FROM (SELECT *, regexp_replace(regexp_replace(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), '^{T.BLANK}+', ''), '{T.BLANK}+$', '') AS x FROM documents)))"""
_SPLIT = f"CASE WHEN sha IS NULL THEN NULL WHEN substr(sha256('{corpus.SALT}' || chr(0) || sha), 1, 16) < '{T.validation_threshold(corpus.FRACTION)}' THEN 'validation' ELSE 'train' END"
_EARLY = "coalesce(reason IN ('non_string', 'empty', 'control_character'), false)"
_STEPS = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value + 1 AS wall, event_id % 7 AS tokens, value AS loss, CASE WHEN event_type = 'view' THEN 0.5 ELSE 0.0 END::DOUBLE AS pause FROM events"
_RUNS = f"""SELECT user_id, count(*) AS steps, (sum(tokens) FILTER (step > 2))::BIGINT AS tokens, coalesce(sum(pause) FILTER (step > 2), 0.0) AS pause_seconds, median(wall) FILTER (step > 2) AS step_median,
    quantile_disc(wall, 0.95) FILTER (step > 2) AS step_p95, max(wall) FILTER (step > 2) AS step_max, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, true AS finite, true AS complete, true AS passed,
    sum(wall) FILTER (step > 2) AS w FROM ({_STEPS}) GROUP BY user_id"""
_W = corpus.WIDTH - 1
_ENTRY = "'{{\"path\":\"shard-' || s_suppkey || '\",\"size_bytes\":' || s_nationkey || '}}'".replace("{{", "{").replace("}}", "}")

SQL = {
    "manifest_events": f"""WITH k AS (SELECT *, {_SPLIT} AS split FROM ({_KEPT})), r AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN split != 'train' THEN 'other_split_' || split ELSE 'accepted' END AS why FROM k)
      SELECT event, n FROM (SELECT 'rows' AS event, count(*) AS n FROM r UNION ALL SELECT why, count(*) FROM r GROUP BY why UNION ALL SELECT 'null:text', count(*) FILTER (text IS NULL) FROM r
      UNION ALL SELECT 'null:lang', count(*) FILTER (lang IS NULL) FROM r UNION ALL SELECT 'null:source', count(*) FILTER (source IS NULL) FROM r UNION ALL SELECT 'null:doc_id', count(*) FILTER (doc_id IS NULL) FROM r) WHERE n > 0""",
    "manifest_documents": f"""SELECT doc_id, sha256('{{"content_sha256":"' || sha || '","source_identity":"documents"' || CASE WHEN doc_id IS NULL THEN '' ELSE ',"upstream_id":"' || doc_id || '"' END || '}}') AS document_id, sha AS content_sha256, over AS truncated, doc_id IS NULL AS fallback_id,
      strlen(t)::BIGINT AS bytes FROM ({_KEPT}) WHERE reason IS NULL AND {_SPLIT} = 'train'""",
    "quality_counts": f"""WITH k AS (SELECT *, min(doc_id) OVER (PARTITION BY sha) AS f FROM ({_KEPT})) SELECT source, CASE WHEN reason IS NOT NULL THEN reason WHEN doc_id != f THEN 'duplicate' ELSE 'accepted' END AS event, count(*) AS n FROM k GROUP BY 1, 2
      UNION ALL SELECT source, 'truncated', count(*) FROM k WHERE over AND NOT {_EARLY} GROUP BY 1""",
    "bounded_audit": "SELECT source, (SELECT count(*) >= 100 FROM documents) AS bounded, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM (SELECT * FROM documents ORDER BY md5(doc_id::VARCHAR) NULLS FIRST, doc_id NULLS FIRST LIMIT 100) GROUP BY source",
    "pack_keep_tail": f"SELECT k AS window_id, least({_W}, t - 1 - k * {_W}) + 1 AS window_tokens, least({_W}, t - 1 - k * {_W}) AS targets FROM (SELECT t, unnest(range(0, (t - 1 + {_W} - 1) // {_W})) AS k FROM (SELECT sum(n)::BIGINT AS t FROM ({corpus._LEN})))",
    "pack_budget_cut": f"SELECT k AS window_id, least({_W}, b - k * {_W}) + 1 AS window_tokens, least({_W}, b - k * {_W}) AS targets FROM (SELECT b, unnest(range(0, (b + {_W} - 1) // {_W})) AS k FROM (SELECT least({BUDGET}, (sum(n)::BIGINT - 1) // 2) AS b FROM ({corpus._LEN})))",
    "target_alignment": f"SELECT k AS window_id, source, sum(targets)::BIGINT AS targets FROM ({corpus._TOUCH}) WHERE k < (SELECT (sum(n)::BIGINT - 1) // {_W} FROM ({corpus._LEN})) GROUP BY k, source",
    "quota_cut_texts": "SELECT conv_id, turn, least(strlen(text) + 1, 64)::BIGINT AS kept, 7 AS last, md5(CASE WHEN strlen(text) + 1 <= 64 THEN text ELSE left(text, list_max(list_filter(range(0, 64), lambda i: strlen(left(text, i)) <= 63))) END) AS text_md5 FROM conversations",
    "quota_truncations": f"SELECT source, count(*) FILTER (n > {QUOTA}) AS fragments, coalesce(sum(n - {QUOTA}) FILTER (n > {QUOTA}), 0)::BIGINT AS removed_tokens FROM ({corpus._LEN}) GROUP BY source",
    "token_round_trips": "SELECT role, count(*) AS texts, 0::BIGINT AS failures, 0::BIGINT AS unknown, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS fallbacks FROM conversations GROUP BY role",
    "memorisation_stream": "SELECT conv_id, (sum(strlen(text)) + count(*))::BIGINT AS tokens, md5(string_agg(ids || '7', ',' ORDER BY turn)) AS stream_md5 FROM (SELECT conv_id, turn, text, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), i * 2 + 1, 2))::INT + 8), ',') || ',' END AS ids FROM conversations) GROUP BY conv_id",
    "framed_digests": "SELECT conv_id, count(*) AS rows, sha256(string_agg(sha256(coalesce(strlen(role), -1) || ':' || coalesce(role, '') || coalesce(strlen(text), -1) || ':' || coalesce(text, '')), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "identity_conflicts": "SELECT source, count(DISTINCT lang) + max((lang IS NULL)::INT) AS identities FROM documents GROUP BY source HAVING count(DISTINCT lang) + max((lang IS NULL)::INT) != 1",
    "strata_counts": """SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS rows, coalesce(k, 0) AS keys, coalesce(e, 0) AS expected, coalesce(a.n, 0) = coalesce(e, 0) AND coalesce(k, 0) = coalesce(a.n, 0) AS holds
      FROM (SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS k FROM documents GROUP BY lang) a FULL JOIN (SELECT lang, count(*) AS e FROM labels JOIN documents USING (doc_id) GROUP BY lang) b ON a.lang IS NOT DISTINCT FROM b.lang""",
    "arm_changes": "SELECT user_id, round(b, 4) AS base, round(o, 4) AS other, round(100.0 * (o - b) / nullif(b, 0), 4) AS change_percent FROM (SELECT user_id, avg(value) FILTER (event_type = 'click') AS b, avg(value) FILTER (event_type = 'view') AS o FROM events GROUP BY user_id)",
    "first_and_steady": "SELECT user_id, min(value) FILTER (k = 1) AS first, count(*) FILTER (k > 1) AS steady, round(avg(value) FILTER (k > 1), 6) AS steady_mean, max(value) FILTER (k > 1) AS steady_max FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY user_id",
    "record_counts": "SELECT event_type, count(*) AS records, count(DISTINCT user_id) AS series, max(event_id) AS last_step FROM events GROUP BY event_type",
    "cache_identity": f"SELECT count(*) AS shards, sum(s_nationkey)::BIGINT AS bytes, sha256('[' || string_agg({_ENTRY}, ',' ORDER BY 'shard-' || s_suppkey) || ']') AS fingerprint FROM supplier",
    "ordered_fingerprints": "SELECT count(*) AS parts, sha256(string_agg(sha256(n_name), ',' ORDER BY n_regionkey > 1, n_nationkey)) AS fingerprint FROM nation",
    "run_rows": f"SELECT user_id, steps, tokens, round(pause_seconds, 6) AS pause_seconds, round(step_median, 6) AS step_median, round(step_p95, 6) AS step_p95, round(step_max, 6) AS step_max, round(first_loss, 6) AS first_loss, round(last_loss, 6) AS last_loss, round(tokens / nullif(w + pause_seconds, 0), 6) AS tokens_per_second, finite, complete, passed FROM ({_RUNS})",
    "pilot_gates": f"""SELECT user_id, gate, holds, CASE WHEN bool_and(holds) OVER (PARTITION BY user_id) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
      SELECT user_id, 'training_gates' AS gate, passed AS holds FROM ({_RUNS}) UNION ALL SELECT user_id, 'long_enough', steps >= 5 FROM ({_RUNS}) UNION ALL SELECT user_id, 'pause_observed', pause_seconds > 0 FROM ({_RUNS}) UNION ALL SELECT user_id, 'loss_fell', last_loss < first_loss FROM ({_RUNS}))""",
    "plan_problems": """WITH a AS (SELECT user_id::BIGINT AS candidate, (event_id % 3)::BIGINT AS repetition, count(*) AS n FROM events WHERE event_id % 3 != 0 GROUP BY 1, 2), b AS (SELECT c_custkey::BIGINT AS candidate, unnest([1, 2])::BIGINT AS repetition, true AS made FROM customer)
      SELECT * FROM (SELECT candidate, repetition, CASE WHEN n IS NULL THEN 'missing' WHEN made IS NULL THEN 'extra' WHEN n > 1 THEN 'twice' END AS problem FROM a FULL JOIN b USING (candidate, repetition)) WHERE problem IS NOT NULL""",
    "log_cadence": f"SELECT user_id, count(*) AS logs, 4::BIGINT AS expected, count(*) = 4 AND bool_and(step % 10 = 0) AS on_cadence FROM ({_STEPS}) WHERE step % 10 = 0 AND step <= 40 OR step = 15 AND user_id % 5 = 0 GROUP BY user_id",
    "proc_counters": "SELECT upper(event_type[1]) || event_type[2:] AS key, sum(event_id * CASE WHEN event_id % 2 = 0 THEN 1024 ELSE 1 END)::BIGINT AS bytes, count(*) AS lines FROM events GROUP BY 1",
    "device_lines": "SELECT user_id::VARCHAR AS device, sum(event_id::DOUBLE) FILTER (event_id % 5 != 0) AS power, count(*) FILTER (event_id % 5 != 0) AS values, count(*) AS lines FROM events GROUP BY 1",
    "top_k_retained": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3",
    "eviction_victim": "SELECT event_id::VARCHAR AS path, value AS used_at FROM events WHERE event_type != 'click' ORDER BY value, event_id::VARCHAR LIMIT 1",
    "counter_merge": "SELECT source, coalesce(a, 0) AS documents, coalesce(b, 0) AS good FROM (SELECT source, count(*) AS a FROM documents GROUP BY source) FULL JOIN (SELECT source, count(*) AS b FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source) USING (source)",
    "lineage_breaks": """SELECT segment, problem FROM (SELECT s.event_id AS segment, CASE WHEN s.event_id % 3 != 0 AND b.event_id IS NULL THEN 'no such parent' WHEN s.event_id % 3 != 0 AND b.event_id % 4 != s.event_id % 4 THEN 'does not start where its parent ends'
      WHEN s.event_id % 3 = 0 AND s.event_id % 4 != 0 THEN 'does not start at 0' END AS problem FROM events s LEFT JOIN events b ON s.event_id % 3 != 0 AND b.event_id = s.event_id - s.event_id % 3 AND b.event_id % 2 = 0) WHERE problem IS NOT NULL""",
    "phase_sums": "SELECT user_id, event_type AS phase, round(sum(value), 4) AS seconds FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, 'all', count(*)::DOUBLE FROM events GROUP BY 1",
    "unexplained_time": "SELECT event_id, round(value - (value / 2 + value / 4) - 0.5, 6) AS unexplained, true AS has_phases FROM events",
    "lifecycle": "SELECT user_id, bool_or(event_type = 'click' AND value <= 50) AND bool_or(event_type = 'view' AND value <= 50) AS complete, NOT bool_or(event_type = 'purchase' AND value > 50) AS clean FROM events GROUP BY user_id",
    "disagreements": "SELECT 'c_mktsegment' AS column, count(DISTINCT c_mktsegment) AS values FROM customer HAVING count(DISTINCT c_mktsegment) > 1",
    "fold_verdict": "SELECT CASE WHEN bool_or(value < 0) THEN 'FAIL' WHEN bool_or(value > 50) THEN 'PASS WITH NOTE' ELSE 'PASS' END AS verdict FROM events",
    "histogram_checks": "SELECT user_id, user_id % 2 = 0 AS valid FROM events GROUP BY user_id",
    "file_changes": """SELECT path, problem FROM (SELECT s_suppkey::VARCHAR AS path, CASE WHEN s_suppkey % 11 = 0 AND s_suppkey % 5 != 0 THEN 'missing' WHEN s_suppkey % 5 = 0 AND s_suppkey % 11 != 0 THEN 'extra' WHEN s_suppkey % 7 = 0 AND s_suppkey % 5 != 0 THEN 'changed' END AS problem FROM supplier) WHERE problem IS NOT NULL""",
    "resource_rates": "SELECT user_id, greatest(arg_max(event_id, k) - arg_min(event_id, k), 0) / 4.0::DOUBLE AS reads_per_second, (arg_min(event_id, k) - arg_max(event_id, k)) / 4.0::DOUBLE AS swap_per_second FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY user_id",
    "memory_stability": """SELECT user_id, l <= f + greatest(1, f * 0.05) AS stable FROM (SELECT user_id, median(value) FILTER (k <= s) AS f, median(value) FILTER (k > m - s) AS l FROM (
      SELECT *, least(20, greatest(1, m // 2)) AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM events)) GROUP BY user_id)""",
    "weaker_thresholds": """SELECT n_name AS name, c AS committed, o AS own FROM (SELECT n_name, CASE WHEN n_regionkey > 2 THEN 'floor' ELSE 'ceiling' END AS kind, (n_nationkey + n_regionkey % 2)::DOUBLE AS c,
      CASE WHEN n_nationkey % 6 != 5 THEN (n_nationkey * CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END)::DOUBLE END AS o FROM nation) WHERE o IS NULL OR kind = 'floor' AND o < c OR kind = 'ceiling' AND o > c""",
    "online_adjustment": "SELECT user_id, round(min(value) * least(1.0, (SELECT avg(value) FROM events WHERE event_type = 'purchase') / avg(value)), 6) AS speed FROM events GROUP BY user_id",
    "disk_forecast": "SELECT s_suppkey, 10000 + s_suppkey * 10 - s_nationkey * 100 - 50 - 1000 AS headroom, 10000 + s_suppkey * 10 - s_nationkey * 100 - 50 - 1000 >= 0 AS enough, (s_nationkey * (6 + ceil(s_suppkey * 10 / 100.0)) + 7)::BIGINT AS run_bytes FROM supplier",
    "paired_regression": "SELECT user_id, round(100.0 * (b - o) / b, 4) AS regression_percent FROM (SELECT user_id, avg(value) FILTER (event_type = 'click') AS b, avg(value) FILTER (event_type = 'purchase') AS o FROM events GROUP BY user_id) WHERE b IS NOT NULL AND o IS NOT NULL",
    "perplexities": f"SELECT user_id, round(nll, 6) AS nll, round(CASE WHEN nll <= {M.MOST_NLL!r} THEN exp(nll) END, 4) AS perplexity, nll > {M.MOST_NLL!r} AS overflow FROM (SELECT user_id, sum(value * CASE WHEN user_id % 4 = 0 THEN 1000 ELSE 0.01 END::DOUBLE) / count(*) AS nll FROM events GROUP BY user_id)",
    "finite_values": "SELECT user_id, NOT bool_or(event_id % 97 = 0) AS finite FROM events GROUP BY user_id",
    "sampler_coverage": f"SELECT user_id, n AS samples, e AS expected, round(n / e, 6) AS coverage FROM (SELECT user_id, count(*) AS n, (floor((max({_SECONDS}) - min({_SECONDS})) / 3600.0) + 1)::BIGINT AS e FROM events GROUP BY user_id)",
    "rejection_determinism": "SELECT user_id, bool_and(value > 20) AS rejected, count(DISTINCT CASE WHEN value > 20 THEN event_type ELSE '' END) = 1 AS deterministic FROM events GROUP BY user_id",
    "benchmark_contained": r"SELECT doc_id, count(DISTINCT item_id) AS items FROM documents d JOIN (SELECT * FROM benchmark WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) >= 3) b ON contains(d.text, b.text) GROUP BY doc_id",
    "overlapping_splits": f"SELECT DISTINCT sha FROM (SELECT {corpus._SHA} AS sha FROM documents WHERE doc_id % 2 = 0) WHERE sha IN (SELECT {corpus._SHA} FROM documents WHERE doc_id % 2 = 1)",
    "manifest_union": "SELECT source, count(*) AS documents FROM (SELECT DISTINCT doc_id, source FROM documents WHERE doc_id IS NOT NULL) GROUP BY source",
    "first_batch": f"SELECT doc_id, span_start, span_end FROM (SELECT doc_id, start AS span_start, least(start + n, {corpus.WIDTH}) AS span_end FROM (SELECT *, (sum(n) OVER (ORDER BY doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start FROM ({corpus._LEN}))) WHERE span_start < {corpus.WIDTH}",
}
