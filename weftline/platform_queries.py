"""Registered queries of stores, job queues, limiters, scripts and catalogs, and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import es5, script
from weftline.operators import lifting, models, summaries, vectors
from weftline.plans import graph as g
from weftline.queries import _EDGES, _edges, query, t
from weftline.sources import kv
from weftline.sources.shared import shared_folder
from weftline.streaming import jobs, queue


def _jobs(spark, sf_dir) -> DataFrame:
    """Events as jobs: half of them COMPLETED, the others NEW or PROCESSING."""
    e = t(spark, sf_dir, "events")
    n = F.col("event_id")
    rows = e.select(
        n.cast("string").alias("id"), F.concat(F.lit("input "), (n % 50).cast("string")).alias("input"), F.concat(F.lit("run-"), (n % 7).cast("string")).alias("jobRunId"), F.col("event_type").alias("queue"),
        F.when(n % 4 < 2, "COMPLETED").when(n % 4 == 2, "NEW").otherwise("PROCESSING").alias("status"), F.when(n % 4 < 2, F.concat(F.lit("output "), n.cast("string"))).alias("output"), (n % 4).cast("int").alias("retries"), F.lit(3).alias("maxRetries"),
        F.when(n % 4 < 2, F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, event_id % 90)")).alias("completedAt"), F.col("ts").alias("createdAt"), F.col("ts").alias("runAfter"))
    return queue.new_jobs(rows, "q", F.col("ts") if "ts" in rows.columns else F.col("createdAt"))


_J = """(SELECT CAST(event_id AS VARCHAR) AS id, event_id AS n, 'input ' || (event_id % 50) AS input, 'run-' || (event_id % 7) AS jobRunId, event_type AS queue,
CASE WHEN event_id % 4 < 2 THEN 'COMPLETED' WHEN event_id % 4 = 2 THEN 'NEW' ELSE 'PROCESSING' END AS status, CASE WHEN event_id % 4 < 2 THEN 'output ' || event_id END AS output,
CAST(event_id % 4 AS INT) AS retries, CASE WHEN event_id % 4 < 2 THEN ts + to_seconds(event_id % 90) END AS completedAt, ts AS createdAt FROM events)"""


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def kv_get(spark, sf_dir):
    return kv.KVTable(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"]).get(7)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def kv_combined(spark, sf_dir):
    table = kv.KVTable(t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])
    return table.get_combined(t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey = 3 THEN 'changed' ELSE CAST(s_nationkey AS VARCHAR) END AS v FROM supplier WHERE s_suppkey <> 5 UNION ALL SELECT -1, 'new', 'added'")
def kv_put_one(spark, sf_dir):
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("v"))
    table = kv.KVTable(rows, ["s_suppkey", "s_name"]).delete({"s_suppkey": 5, "s_name": rows.filter("s_suppkey = 5").first().s_name})
    name = rows.filter("s_suppkey = 3").first().s_name  # the keys of a point write are its caller's
    return table.put_one({"s_suppkey": 3, "s_name": name}, "changed").put_one({"s_suppkey": -1, "s_name": "new"}, {"v": "added"}).get_all()


@query(f"SELECT id, status, jobRunId FROM {_J} WHERE jobRunId = 'run-3'")
def queue_by_run(spark, sf_dir):
    return _jobs(spark, sf_dir).filter(F.col("jobRunId") == "run-3").select("id", "status", "jobRunId")


@query(f"""SELECT i.input, arg_max(j.output, (j.completedAt, j.id)) AS output FROM (SELECT 'input ' || r AS input FROM range(60) x(r)) i LEFT JOIN {_J} j ON i.input = j.input AND j.status = 'COMPLETED' GROUP BY 1""")
def queue_output_for_input(spark, sf_dir):
    return queue.outputs_for(_jobs(spark, sf_dir), spark.range(60).select(F.concat(F.lit("input "), F.col("id").cast("string")).alias("input"))).select("input", "output")


@query(f"""SELECT id, CASE WHEN status = 'COMPLETED' OR n % 3 = 2 THEN status WHEN n % 3 = 0 THEN 'COMPLETED' WHEN n % 5 < 3 AND retries + 1 < 3 THEN 'NEW' ELSE 'FAILED' END AS status,
CASE WHEN status <> 'COMPLETED' AND n % 3 = 1 THEN retries + 1 ELSE retries END AS retries,
CASE WHEN status <> 'COMPLETED' AND n % 3 = 1 THEN CASE WHEN n % 5 < 3 THEN 'RetryableJobError' ELSE 'PermanentJobError' END END AS errorCode FROM {_J}""")
def queue_complete(spark, sf_dir):
    n = F.col("id").cast("long")
    bad = n % 3 == 1
    results = _jobs(spark, sf_dir).filter(n % 3 != 2).select("id", F.lit("done").alias("output"), F.when(bad, "boom").alias("error"), F.when(bad, F.when(n % 5 < 3, queue.RETRYABLE).otherwise(queue.PERMANENT)).alias("errorCode"), F.lit(None).cast("timestamp").alias("retryAt"))
    return queue.completed(_jobs(spark, sf_dir), results, F.expr("timestamp '2030-01-01 00:00:00'")).select("id", "status", "retries", "errorCode")


@query(f"SELECT id, CASE WHEN jobRunId = 'run-1' AND status = 'NEW' THEN 'FAILED' WHEN jobRunId = 'run-1' AND status = 'PROCESSING' THEN 'ABORTING' ELSE status END AS status, CASE WHEN jobRunId = 'run-1' AND status = 'NEW' THEN 'AbortSignalJobError' END AS errorCode FROM {_J}")
def queue_abort_run(spark, sf_dir):
    return queue.aborted(_jobs(spark, sf_dir), F.col("jobRunId") == "run-1", F.expr("timestamp '2030-01-01 00:00:00'")).select("id", "status", "errorCode")


@query(f"SELECT queue, count(*) AS total, count(*) FILTER (status = 'NEW') AS waiting, count(*) FILTER (status = 'COMPLETED') AS completed, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS aborted, sum(retries)::BIGINT AS retried, round(avg(CASE WHEN status = 'COMPLETED' THEN (epoch_us(completedAt) - epoch_us(createdAt)) / 1e6 END), 6) AS average_seconds FROM {_J} GROUP BY 1")
def job_stats(spark, sf_dir):
    return queue.stats(_jobs(spark, sf_dir)).withColumn("average_seconds", F.round("average_seconds", 6))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_type(spark, sf_dir):
    return summaries.count_by(t(spark, sf_dir, "events"), "event_type")


@query("SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def truth_and_mean(spark, sf_dir):
    p = F.col("o_totalprice")
    return t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(summaries.all_of(p > 1000).alias("every"), summaries.any_of(p > 400000).alias("some"), F.round(summaries.mean(p), 6).alias("mean"))


@query("SELECT user_id, max(ts) AS latest, count(*) AS n FROM events GROUP BY 1")
def latest_and_count(spark, sf_dir):
    return summaries.latest_and_count(t(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT event_id, gap_ms FROM (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts))) / 1000 AS gap_ms FROM events) WHERE gap_ms < 3600000 AND gap_ms > 0")
def limiter_delay_gap(spark, sf_dir):
    return jobs_after(spark, sf_dir).filter("gap_ms > 0").select("event_id", "gap_ms")


def jobs_after(spark, sf_dir) -> DataFrame:
    return queue.delay_violations(t(spark, sf_dir, "events"), "user_id", "ts", 3_600_000)


@query("SELECT user_id, moment FROM (SELECT user_id, ts AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events) WHERE r = 4")
def limiter_nth_oldest(spark, sf_dir):
    return queue.nth_oldest(t(spark, sf_dir, "events"), "user_id", "ts", 4).withColumnRenamed("at", "moment")


@query("SELECT event_id, greatest(ts, ts + to_minutes(CAST(event_id % 5 AS INT)), CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 3 MINUTE ELSE ts END) AS next FROM events")
def limiter_composite(spark, sf_dir):
    a, b = F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(event_id % 5 as int), 0)"), F.expr("case when event_id % 3 = 0 then ts + interval 3 minutes end")
    return t(spark, sf_dir, "events").select("event_id", queue.composite_next(F.col("ts"), [a, b]).alias("next"))


@query("SELECT user_id, count(*) AS attempts, max(ts) AS latest FROM events WHERE ts > (SELECT min(ts) + INTERVAL 2 DAY FROM events) GROUP BY 1")
def limiter_usage(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    since = e.agg((F.min("ts") + F.expr("interval 2 days")).alias("since"))
    return queue.usage(e.crossJoin(F.broadcast(since)), "user_id", "ts", F.col("since"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n_events FROM events GROUP BY 1")
def stream_job_state(spark, sf_dir):
    """The state of every job out of a stream of its events, written by each trigger."""
    path = f"{shared_folder(spark)}/weftline-core/states-{uuid.uuid4().hex}"
    source = t(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    states = queue.job_states(stream, "user_id", ["ts", "event_id"], ["event_type", "value"])
    run = states.writeStream.outputMode("complete").option("checkpointLocation", f"{path}-log").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    run.awaitTermination()
    return spark.read.parquet(path)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def es5_json(spark, sf_dir):
    parsed = es5.json_parse(F.col("props"), "k bigint")
    return t(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), es5.json_stringify(parsed).alias("again"))


@query("SELECT p_partkey, regexp_matches(p_type, 'BRASS$', 'i') AS has, regexp_replace(p_type, '[aeiou]', '_', 'gi') AS every, regexp_replace(p_name, '([a-z])([a-z])', '\\2\\1') AS swapped, [regexp_extract(p_brand, '(\\d)(\\d)', 0), regexp_extract(p_brand, '(\\d)(\\d)', 1), regexp_extract(p_brand, '(\\d)(\\d)', 2)] AS found FROM part")
def es5_regex(spark, sf_dir):
    c = F.col
    found = F.coalesce(es5.exec(c("p_brand"), r"(\d)(\d)"), F.array(F.lit(""), F.lit(""), F.lit("")))
    return t(spark, sf_dir, "part").select("p_partkey", es5.test(c("p_type"), "BRASS$", "i").alias("has"), es5.replace(c("p_type"), "[aeiou]", "_", "gi").alias("every"), es5.replace(c("p_name"), "([a-z])([a-z])", "$2$1").alias("swapped"), found.alias("found"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(sqrt(abs(c_acctbal)), 9) AS s, CASE WHEN c_acctbal < 0 THEN 'nan' WHEN c_acctbal = 0 THEN 'low' ELSE CAST(round(ln(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 6) AS VARCHAR) END AS l, greatest(c_acctbal, 0.0) AS mx, least(c_acctbal, 0.0) AS mn, CAST(c_custkey AS DOUBLE) % 7.0 AS m FROM customer")
def es5_math(spark, sf_dir):
    b = F.col("c_acctbal")
    log = F.when(b < 0, "nan").when(b == 0, "low").otherwise(F.round(es5.MATH["log"](b), 6).cast("string"))
    return t(spark, sf_dir, "customer").select("c_custkey", es5.MATH["abs"](b).alias("a"), es5.MATH["ceil"](b).cast("double").alias("c"), es5.MATH["floor"](b).cast("double").alias("f"), F.round(es5.MATH["sqrt"](F.abs(b)), 9).alias("s"), log.alias("l"), es5.maximum(b, F.lit(0.0)).alias("mx"), es5.minimum(b, F.lit(0.0)).alias("mn"), es5.remainder(F.col("c_custkey"), F.lit(7)).alias("m"))


@query("SELECT p_partkey, url_encode(p_name) AS coded, p_name AS back FROM part")
def es5_uri(spark, sf_dir):
    coded = es5.encode_uri_component(F.col("p_name"))
    return t(spark, sf_dir, "part").select("p_partkey", coded.alias("coded"), es5.decode_uri_component(coded).alias("back"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, printf('%.1f', CAST(l_linenumber AS DOUBLE)) AS fixed, lower(to_base(l_partkey, 16)) AS hex, CAST(l_partkey * 10000000 AS VARCHAR) AS big FROM lineitem")
def es5_number_text(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", es5.number_text(F.col("l_quantity")).alias("quantity"), es5.to_fixed(F.col("l_linenumber"), 1).alias("fixed"), es5.to_radix(F.col("l_partkey"), 16).alias("hex"), es5.number_text(F.col("l_partkey") * 1e7).alias("big"))


@query("""WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1)
SELECT o_custkey, len(ks)::INT AS n, ks[len(ks)] AS popped, ks[1:len(ks) - 1] AS rest, list_reverse(ks) AS back, len(list_filter(ks, lambda x: x % 2 = 0)) = len(ks) AS every, len(list_filter(ks, lambda x: x % 2 = 0)) > 0 AS some, list_transform(ks, lambda x: x * 2) AS doubled, (list_position(ks, ks[len(ks)]) - 1)::INT AS last FROM a""")
def es5_array_more(spark, sf_dir):
    ks, even = F.col("ks"), lambda x: x % 2 == 0
    rows = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    popped, rest = es5.pop(ks)
    return rows.select("o_custkey", es5.array_length(ks).alias("n"), popped.alias("popped"), rest.alias("rest"), es5.reverse(ks).alias("back"), es5.every(ks, even).alias("every"), es5.some(ks, even).alias("some"), es5.array_map(ks, lambda x: x * 2).alias("doubled"), es5.array_last_index_of(ks, F.element_at(ks, -1)).alias("last"))


@query("SELECT c_custkey, '{\"n\":' || (c_custkey * (c_custkey + 1) // 2) || ',\"name\":\"' || upper(c_name) || '\"}' AS output, CASE WHEN c_custkey % 10 = 0 THEN 'refused' END AS error FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, NULL, 'refused' FROM customer WHERE c_custkey % 10 = 0")
def javascript_task(spark, sf_dir):
    code = """
    function sum(n) { var s = 0; for (var i = 1; i <= n; i++) s += i; return s; }
    if (input.c_custkey % 10 === 0) throw new Error('refused');
    ({n: input.c_custkey < 300 ? sum(input.c_custkey) : input.c_custkey * (input.c_custkey + 1) / 2, name: input.c_name.toUpperCase()})
    """
    return script.javascript(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), code, ["c_custkey", "c_name"]).drop("c_name")


@query(f"""WITH e AS {_EDGES} SELECT e.target AS id, 'root ' || r.source AS region, e.target AS own FROM e JOIN e r ON e.source = r.target WHERE substr(e.target, 1, 1) = 'c' """)
def provenance_merge(spark, sf_dir):
    """Provenance of two layers: a customer gets its nation's, which got its region's."""
    e = _edges(spark, sf_dir).withColumn("ord", F.lit(0))
    ids = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    own = F.when(F.col("id").startswith("r"), F.create_map(F.lit("region"), F.concat(F.lit("root "), F.col("id")), F.lit("own"), F.col("id"))).otherwise(F.create_map(F.lit("own"), F.col("id")))
    nodes = ids.withColumn("provenance", own)
    first = g.provenance_merge(e, nodes.filter("id not like 'c%'"))
    out = g.provenance_merge(e, first.unionByName(nodes.filter("id like 'c%'")))
    return out.filter("id like 'c%'").select("id", F.col("provenance")["region"].alias("region"), F.col("provenance")["own"].alias("own"))


@query(f"WITH e AS {_EDGES} SELECT target AS of, source AS id, substr(source, 1, 1) AS kind FROM e")
def graph_neighbours(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = e.select(F.col("source").alias("id")).union(e.select("target")).distinct().withColumn("kind", F.substr("id", F.lit(1), F.lit(1)))
    return g.neighbours(nodes, e)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def graph_parallel_branches(spark, sf_dir):
    """Two branches of two tasks each, out of JSON and back, run once and found in the memo the second time."""
    pick = lambda name, where, columns: g.register(g.Operator(name, lambda table: {"table": table.filter(where).select(*columns)}, [g.Port("table", "table", required=True)], [g.Port("table", "table")]))
    pick("InRegionTwo", "n_regionkey = 2", ["n_nationkey", "n_name"])
    pick("LaterRegions", "r_regionkey > 1", [F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")])
    b = g.Builder().parallel(lambda b: b.Scan(spark=spark, path=f"{sf_dir}/nation.parquet").InRegionTwo(), lambda b: b.Scan(spark=spark, path=f"{sf_dir}/region.parquet").LaterRegions())
    memo = g.Memo()
    first = g.TaskGraph.from_json(b.to_json()).run(memo=memo)[0]["outputs"]
    again = b.run(memo=memo)[0]["outputs"]
    if memo.hits != 4 or [x["table"] for x in first] != [x["table"] for x in again]:
        raise AssertionError("the memo did not find what was run before")
    return summaries.bag_union(*[x["table"] for x in first])


@query("SELECT p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS embedding_model, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS summarization_model FROM part")
def download_model_ports(spark, sf_dir):
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))
    tasks = parts.filter("name % 2 = 0").select(F.lit("TextEmbeddingTask").alias("task"), F.col("name").alias("model")).unionByName(parts.filter("name % 3 = 0").select(F.lit("TextSummaryTask").alias("task"), F.col("name").alias("model")))
    return models.download(kv.ModelCatalog(parts, tasks)).select("name", "embedding_model", "summarization_model")


@query("""SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) DESC, v.vec_id) AS rank
FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5""")
def vector_topk_per_query(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    out = vectors.top_k_of_each(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)
    from pyspark.sql import Window as W

    return out.select("query_id", "vec_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("bigint").alias("rank"))


@query("SELECT c_custkey, first, rest FROM (SELECT o_custkey AS c_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1), LATERAL (SELECT ks[1] AS first, len(ks) - 1 AS rest)")
def lifted_compat(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.row_number().over(_by("o_custkey", "o_orderkey")) > 1, F.col("o_orderkey")).alias("later"))
    out = lifting.collect(rows, ["c_custkey"], "o_orderkey", ["o_orderkey", "later"], compat=True)
    return out.select("c_custkey", F.get("o_orderkey", F.lit(0)).alias("first"), F.size("later").cast("bigint").alias("rest"))


def _by(key: str, order: str):
    from pyspark.sql import Window as W

    return W.partitionBy(key).orderBy(order)


@query("SELECT user_id, event_id, least(100.0, greatest(0.0, value)) AS progress FROM (SELECT *, lag(least(100.0, greatest(0.0, value))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> least(100.0, greatest(0.0, value))")
def stream_progress(spark, sf_dir):
    rows = t(spark, sf_dir, "events").withColumn("progress", jobs.clamp_progress(F.col("value")))
    return jobs.changes(rows, "user_id", ["ts", "event_id"], ["progress"]).select("user_id", "event_id", "progress")
