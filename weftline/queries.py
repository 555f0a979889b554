"""Registered queries of the core library and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions import es5
from weftline.operators import documents, lifting, models, summaries, vectors
from weftline.plans import graph as g
from weftline.sources import kv, stores
from weftline.operators.sinks import applied, logged
from weftline.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "similarity_topk"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


g.register(g.Operator("Scan", lambda spark, path: {"table": spark.read.parquet(path)}, [g.Port("spark"), g.Port("path", "text", required=True)], [g.Port("table", "table")]))
g.register(g.Operator("TopK", lambda table, query, k: {"table": vectors.top_k(table, query, k)}, [g.Port("table", "table", required=True), g.Port("query", "any"), g.Port("k", "number")], [g.Port("table", "table")]))
g.register(g.Operator("Select", lambda table, columns: {"table": table.select(*columns)}, [g.Port("table", "table", required=True), g.Port("columns", "text", True)], [g.Port("table", "table")]))
g.register(g.Operator("DebugLog", lambda table, log_level: {"table": logged(table, log_level)}, [g.Port("table", "table", required=True), g.Port("log_level", "log_level", default="info")], [g.Port("table", "table")], side_effects=True))
g.register(g.Operator("Lambda", lambda fn, input: {"output": applied(fn, input)}, [g.Port("fn", "any"), g.Port("input")], [g.Port("output")]))

_DOT = "list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_MAG = "sqrt(list_dot_product(CAST({0}.embedding AS DOUBLE[]), CAST({0}.embedding AS DOUBLE[])))"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    """The query: one row of one vector, joined when the plan runs."""
    return t(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query"))


@query(f"SELECT v.vec_id, v.label, {_DOT} / ({_MAG.format('v')} * {_MAG.format('q')}) AS score FROM embeddings v, {_Q} ORDER BY score DESC, vec_id LIMIT 10")
def similarity_topk(spark, sf_dir):
    b = g.Builder().add("Scan", spark=spark, path=f"{sf_dir}/embeddings.parquet").add("TopK", query=_vector(spark, sf_dir), k=10).add("Select", columns=["vec_id", "label", "score"])
    return b.run()[0]["table"]


@query(f"SELECT v.vec_id, 1.0 - (1.0 - {_DOT}) / ({_MAG.format('v')} * {_MAG.format('q')}) AS score FROM embeddings v, {_Q}")
def similarity_reference(spark, sf_dir):
    return vectors.top_k(t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), None, metric="reference").select("vec_id", "score")


@query(f"SELECT v.vec_id, 1.0 - {_DOT} AS distance, {_MAG.format('v')} AS magnitude FROM embeddings v, {_Q}")
def vector_inner_magnitude(spark, sf_dir):
    return vectors.against(t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)).select("vec_id", vectors.inner(F.col("embedding"), F.col("query")).alias("distance"), vectors.magnitude(F.col("embedding")).alias("magnitude"))


@query(f"SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) / {_MAG.format('v')} AS x FROM embeddings v, range(64) r(i)")
def vector_normalize(spark, sf_dir):
    e = vectors.checked_dimension(F.col("embedding"), 64)
    return t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.normalize(e)).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("i"), "x")


@query("""SELECT v.vec_id, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(a || b)) AS jaccard FROM
(SELECT vec_id, list_distinct(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 20) AS INT))) AS a FROM embeddings) v,
(SELECT list_distinct(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 20) AS INT))) AS b FROM embeddings WHERE vec_id = 0) q""")
def similarity_jaccard(spark, sf_dir):
    grid = lambda c: F.array_distinct(F.transform(c, lambda x: F.floor(x.cast("double") * 20).cast("int")))
    return vectors.against(t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)).select("vec_id", vectors.score(grid(F.col("embedding")), grid(F.col("query")), "jaccard").alias("jaccard"))


@query("""SELECT v.vec_id, CAST(len(list_filter(range(1, 65), lambda i: (v.embedding[i] > 0) <> (q.embedding[i] > 0))) AS INT) AS hamming FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""")
def similarity_hamming(spark, sf_dir):
    sign = lambda c: F.transform(c, lambda x: (x > 0).cast("int"))
    return vectors.against(t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)).select("vec_id", vectors.score(sign(F.col("embedding")), sign(F.col("query")), "hamming").alias("hamming"))


@query("""WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1)
SELECT o_custkey, k, m, (list_position(ks, k) - 1) * 3 + list_position(['air', 'rail', 'ship'], m) AS child
FROM (SELECT o_custkey, ks, unnest(ks) AS k FROM a), (SELECT unnest(['air', 'rail', 'ship']) AS m)""")
def lifted_combinations(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return lifting.combinations(rows.withColumn("m", F.array(F.lit("air"), F.lit("rail"), F.lit("ship"))), ["k", "m"])


@query("SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_returnflag) AS quantity, list(l_returnflag ORDER BY l_linenumber, l_quantity, l_returnflag) AS flag FROM lineitem GROUP BY 1")
def lifted_collect(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    return lifting.collect(rows, ["l_orderkey"], "l_linenumber", ["quantity", "flag"])


_EDGES = "(SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || n_nationkey, 'c' || c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey)"


def _edges(spark, sf_dir) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation = t(spark, sf_dir, "nation")
    a = nation.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
    return a.unionByName(t(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("source"), name("c", "c_custkey").alias("target")))


@query(f"""WITH e AS {_EDGES}, n AS (SELECT source AS id FROM e UNION SELECT target FROM e)
SELECT id, CASE substr(id, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS layer FROM n""")
def graph_layers(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return g.table_layers(e.select(F.col("source").alias("id")).union(e.select("target")).distinct(), e)


@query(f"SELECT source AS id, count(*) AS n_targets FROM {_EDGES} GROUP BY 1")
def graph_target_flows(spark, sf_dir):
    return g.flow_counts(_edges(spark, sf_dir)).withColumnRenamed("n", "n_targets")


@query("""SELECT c_nationkey AS target, CASE WHEN count(*) = 1 THEN 'object' ELSE 'array' END AS form, list(c_custkey ORDER BY c_custkey) AS sources FROM customer GROUP BY 1""")
def graph_dependency_fold(spark, sf_dir):
    return g.dependency_fold(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("target"), F.lit("input").alias("input"))).drop("input")


@query("SELECT l_orderkey, source, target FROM (SELECT l_orderkey, l_linenumber AS source, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS target FROM lineitem) WHERE target IS NOT NULL")
def graph_serial_edges(spark, sf_dir):
    return g.serial_edges(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def kv_last_write(spark, sf_dir):
    return kv.last_write(t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer
UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_custkey % 5 = 0""")
def kv_upsert(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = rows.filter("c_custkey % 3 = 0").withColumn("segment", F.lit("changed"))
    more = rows.filter("c_custkey % 5 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("new").alias("segment"))
    return kv.KVTable(rows, ["c_custkey"]).put(new.unionByName(more)).get_all()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def kv_search(spark, sf_dir):
    table = kv.KVTable(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"], ["o_orderstatus"])
    return table.search({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("SELECT count(*) AS size FROM orders WHERE o_orderkey <> 7")
def kv_delete_size(spark, sf_dir):
    return kv.KVTable(t(spark, sf_dir, "orders"), ["o_orderkey"]).delete({"o_orderkey": 7}).size()


_FP = "sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}')"


@query(f"SELECT n_nationkey, {_FP} AS fingerprint, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS cached FROM nation")
def memo_probe(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    held = nation.filter("n_nationkey % 2 = 0").select(kv.fingerprint(["n_regionkey", "n_nationkey"]).alias("fingerprint"), F.col("n_name").alias("cached"))
    return stores.probe(nation, ["n_regionkey", "n_nationkey"], held).select("n_nationkey", "fingerprint", "cached")


def _catalog(spark, sf_dir) -> kv.ModelCatalog:
    parts = t(spark, sf_dir, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("name"), "p_brand", "p_size")
    return kv.ModelCatalog(parts, t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), F.col("l_partkey").alias("model")).distinct())


@query("SELECT DISTINCT p_partkey AS name, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 7 AND p_partkey % 4 <> 0")
def models_by_task(spark, sf_dir):
    return _catalog(spark, sf_dir).models_by_task(7)


@query("SELECT DISTINCT l_suppkey AS task FROM lineitem WHERE l_partkey = 3")
def tasks_by_model(spark, sf_dir):
    return _catalog(spark, sf_dir).tasks_by_model(3)


@query("SELECT DISTINCT l_suppkey AS task, l_partkey AS model FROM lineitem WHERE l_partkey % 4 = 0 OR l_partkey NOT IN (SELECT p_partkey FROM part)")
def models_dangling(spark, sf_dir):
    return _catalog(spark, sf_dir).dangling()


@query("SELECT doc_id, ord, content FROM (SELECT doc_id, unnest(p) AS content, generate_subscripts(p, 1) - 1 AS ord FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents))")
def document_paragraphs(spark, sf_dir):
    return documents.paragraphs(t(spark, sf_dir, "documents"))


@query("""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, count(*) AS n, sum(length(line)) AS chars FROM l WHERE line <> '' GROUP BY 1""")
def document_line_counts(spark, sf_dir):
    return documents.paragraphs(t(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


_MARKDOWN = """WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
a AS (SELECT *, regexp_matches(line, '^#{1,6}\\s') AS head, contains(line, '|') AS pipe, starts_with(trim(line), '|') AND contains(trim(line)[2:], '|') AS opens FROM l),
b AS (SELECT *, sum(CASE WHEN pipe AND NOT head THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM a),
c AS (SELECT *, CASE WHEN head THEN 'header' WHEN pipe AND bool_or(opens) OVER (PARTITION BY doc_id, run, head, pipe ORDER BY ord) THEN 'table' ELSE 'text' END AS kind FROM b),
d AS (SELECT *, CASE WHEN kind = 'header' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) OR (kind = 'table' AND run <> lag(run) OVER (PARTITION BY doc_id ORDER BY ord)) THEN 1 ELSE 0 END AS new,
  length(regexp_extract(line, '^(#{1,6})\\s', 1)) = 1 AS top FROM c),
e AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS island, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY ord) AS section, count(*) FILTER (head AND top) OVER (PARTITION BY doc_id ORDER BY ord) AS tops FROM d),
f AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id, tops ORDER BY ord) AS depth FROM e),
g AS (SELECT doc_id, min(ord)::INT AS ord, min(section)::INT AS section, min(depth)::INT AS depth, kind, string_agg(line, chr(10) ORDER BY ord) AS content FROM f GROUP BY doc_id, island, kind),
m AS (SELECT doc_id, ord, section, depth, kind, CASE kind WHEN 'header' THEN regexp_extract(content, '^(#{1,6})\\s+(.*)$', 2) WHEN 'text' THEN regexp_replace(regexp_replace(content, '^[\\s\\x{00A0}\\x{FEFF}]+', ''), '[\\s\\x{00A0}\\x{FEFF}]+$', '') ELSE content END AS content FROM g)"""


@query(_MARKDOWN + " SELECT doc_id, ord, section, depth, kind, content, CAST(NULL AS VARCHAR) AS alt, CAST(NULL AS VARCHAR) AS src FROM m WHERE kind <> 'text' OR content <> ''")
def markdown_fragments(spark, sf_dir):
    return documents.markdown_fragments(t(spark, sf_dir, "documents")).select("doc_id", "ord", "section", "depth", "kind", "content", "alt", "src")


@query(_MARKDOWN + " SELECT d.doc_id, coalesce(x.texts, []) AS texts FROM documents d LEFT JOIN (SELECT doc_id, list(content ORDER BY ord) AS texts FROM m WHERE kind <> 'text' OR content <> '' GROUP BY 1) x USING (doc_id)")
def document_splitter(spark, sf_dir):
    return documents.split_texts(t(spark, sf_dir, "documents"))


@query("""SELECT p_partkey, p_name[2:2] AS char_at, strpos(p_name, 'a') - 1 AS index_of, CASE WHEN strpos(reverse(p_name), 'a') = 0 THEN -1 ELSE length(p_name) - strpos(reverse(p_name), 'a') END AS last_index,
p_name[3:5] AS sliced, right(p_name, 3) AS tail, upper(p_name) AS up, regexp_replace(p_name, 'a', '_') AS replaced, string_split(p_name, ' ')[1:2] AS parts, length(regexp_extract_all(p_name, '[aeiou]')) AS vowels FROM part""")
def es5_strings(spark, sf_dir):
    s = F.col("p_name")
    return t(spark, sf_dir, "part").select("p_partkey", es5.char_at(s, 1).alias("char_at"), es5.index_of(s, F.lit("a")).alias("index_of"), es5.last_index_of(s, "a").alias("last_index"), es5.slice_text(s, 2, 5).alias("sliced"), es5.slice_text(s, -3).alias("tail"), F.upper(s).alias("up"), es5.replace_first(s, "a", "_").alias("replaced"), es5.split(s, " ", 2).alias("parts"), F.size(es5.match_all(s, "[aeiou]")).alias("vowels"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice + 0.5)::BIGINT AS rounded, CAST(l_quantity AS INT) & 12 AS a, CAST(l_quantity AS INT) | 3 AS o, xor(CAST(l_quantity AS INT), 5) AS x,
CAST(l_quantity AS INT) << 2 AS sh, CAST(l_quantity AS BIGINT) >> 1 AS sr, greatest(l_quantity, 10.0) AS mx, l_discount <> 0 AS truthy, CASE WHEN l_discount <> 0 THEN l_discount ELSE -1.0 END AS either FROM lineitem""")
def es5_numbers(spark, sf_dir):
    q = es5.to_int32(F.col("l_quantity"))
    d = F.col("l_discount")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", es5.round_half_up(F.col("l_extendedprice")).alias("rounded"), q.bitwiseAND(12).alias("a"), q.bitwiseOR(3).alias("o"), q.bitwiseXOR(5).alias("x"), F.shiftleft(q, 2).alias("sh"), es5.shift_right_unsigned(q, 1).alias("sr"), F.greatest("l_quantity", F.lit(10.0)).alias("mx"), es5.truthy_number(d).alias("truthy"), es5.either(d, F.lit(-1.0), es5.truthy_number(d)).alias("either"))


@query("""SELECT event_id, year(ts)::INT AS full_year, month(ts)::INT - 1 AS month, day(ts)::INT AS date, dayofweek(ts)::INT AS day, hour(ts)::INT AS hours, minute(ts)::INT AS minutes, second(ts)::INT AS seconds, epoch_us(ts) // 1000 AS time,
strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events""")
def es5_dates(spark, sf_dir):
    ts = F.col("ts")
    return t(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in es5.date_parts(ts).items()], es5.iso(ts).alias("iso"))


@query("""WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ks FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_transform(ks, lambda x: CAST(x AS VARCHAR))), ',') AS sorted, array_to_string(ks[1:2], '-') AS head, ks[len(ks)] AS popped, list_sum(ks)::BIGINT AS total,
len(list_filter(ks, lambda x: x % 2 = 0)) AS evens, coalesce(list_position(ks, ks[2]) - 1, -1)::INT AS at FROM a""")
def es5_arrays(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: r["l_partkey"]).alias("ks"))
    ks = F.col("ks")
    return rows.select("l_orderkey", es5.array_join(es5.sort_as_text(ks)).alias("sorted"), es5.array_join(es5.array_slice(ks, 0, 2), "-").alias("head"), F.element_at(ks, -1).alias("popped"), es5.fold(ks, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size(F.filter(ks, lambda x: x % 2 == 0)).alias("evens"), F.when(F.size(ks) > 1, es5.array_index_of(ks, F.get(ks, 1))).otherwise(-1).alias("at"))


def _jobs(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("queue"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 90 as int), 0)")).alias("run_after"), F.when(F.col("event_id") % 3 == 0, "COMPLETED").otherwise("NEW").alias("status"), (F.col("event_id") % 4).cast("int").alias("retries"), F.when(F.col("event_id") % 5 < 2, "boom").alias("error"), (F.col("event_id") % 2 == 0).alias("retryable"), "user_id", "value")


_JOBS = "(SELECT event_id AS id, event_type AS queue, ts AS created_at, ts + to_minutes(CAST(event_id % 90 AS INT)) AS run_after, CASE WHEN event_id % 3 = 0 THEN 'COMPLETED' ELSE 'NEW' END AS status, CAST(event_id % 4 AS INT) AS retries, CASE WHEN event_id % 5 < 2 THEN 'boom' END AS error, event_id % 2 = 0 AS retryable, user_id, value FROM events)"


def _at_first_day(spark, sf_dir) -> DataFrame:
    """The jobs with the moment one day after the first event, a table of one row."""
    now = t(spark, sf_dir, "events").agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("now"))
    return _jobs(spark, sf_dir).crossJoin(F.broadcast(now))


@query(f"SELECT id, CASE WHEN error IS NULL THEN 'COMPLETED' WHEN retryable AND retries + 1 < 3 THEN 'NEW' ELSE 'FAILED' END AS status FROM {_JOBS}")
def job_transitions(spark, sf_dir):
    return _jobs(spark, sf_dir).select("id", jobs.completed_status(F.col("error"), F.col("retryable"), F.col("retries"), F.lit(3)).alias("status"))


@query(f"SELECT id, queue, run_after FROM {_JOBS} WHERE status = 'NEW' AND run_after > (SELECT min(ts) + INTERVAL 1 DAY FROM events) ORDER BY run_after, id LIMIT 100")
def job_peek(spark, sf_dir):
    return jobs.peek(_at_first_day(spark, sf_dir), F.col("now")).select("id", "queue", "run_after")


@query(f"SELECT id, queue FROM {_JOBS} WHERE status = 'NEW' AND run_after <= (SELECT min(ts) + INTERVAL 1 DAY FROM events) ORDER BY created_at, id LIMIT 1")
def job_next(spark, sf_dir):
    return jobs.next_job(_at_first_day(spark, sf_dir), F.col("now")).select("id", "queue")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type OR before IS NULL")
def job_progress_changes(spark, sf_dir):
    return jobs.changes(t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def limiter_window_counts(spark, sf_dir):
    return jobs.window_counts(t(spark, sf_dir, "events"), "user_id", "ts", 86400).select("event_id", "in_window")


@query("""WITH u AS (SELECT user_id, list({'at': epoch_us(ts), 'id': event_id} ORDER BY ts, event_id) AS xs FROM events GROUP BY 1),
r AS (SELECT user_id, list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: CASE WHEN len(a) < 4 OR a[len(a) - 3].at <= b[1].at - 86400000000 THEN list_concat(a, b) ELSE a END) AS ok FROM u)
SELECT user_id, event_id, list_contains(list_transform(ok, lambda x: x.id), event_id) AS admitted FROM events JOIN r USING (user_id)""")
def limiter_replay(spark, sf_dir):
    return jobs.replay_limiter(t(spark, sf_dir, "events"), "user_id", "ts", "event_id", 4, 86400)


@query("""WITH e AS (SELECT event_type, ts AS moment, 1 AS d FROM events UNION ALL SELECT event_type, ts + to_minutes(CAST(event_id % 90 AS INT) + 1), -1 FROM events), s AS (SELECT event_type, moment, sum(d) AS d FROM e GROUP BY ALL)
SELECT event_type, moment, CAST(sum(d) OVER (PARTITION BY event_type ORDER BY moment) AS BIGINT) AS running FROM s""")
def limiter_running(spark, sf_dir):
    rows = t(spark, sf_dir, "events").withColumn("end", F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 90 as int) + 1, 0)"))
    return jobs.running_counts(rows, "event_type", "ts", "end")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return jobs.windowed_counts(t(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


@query("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def distinct_in_order(spark, sf_dir):
    return summaries.distinct_in_order(t(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def bag_union(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return summaries.bag_union(n, t(spark, sf_dir, "region").select(F.col("r_name").alias("name")), n)


@query("SELECT c_custkey, CAST(round(least(100 * (1 - exp(-0.05 * c_nationkey)), 100)) AS DOUBLE) AS progress, least(100.0, greatest(0.0, c_acctbal)) AS clamped FROM customer")
def progress_values(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", es5.progress_curve(F.col("c_nationkey")).alias("progress"), jobs.clamp_progress(F.col("c_acctbal")).alias("clamped"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM conversations),
p AS (SELECT conv_id, turn, ((strpos('0123456789abcdef', md5(w)[3]) - 1) * 16 + strpos('0123456789abcdef', md5(w)[4]) - 1) % 64 AS k, 1 - 2 * ((strpos('0123456789abcdef', md5(w)[5]) - 1) % 2) AS v FROM w),
s AS (SELECT conv_id, turn, k, sum(v) AS v FROM p GROUP BY ALL), n AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS n, map(list(k), list(v)) AS m FROM s GROUP BY ALL)
SELECT c.conv_id, c.turn, list_transform(range(64), lambda i: CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE CAST(coalesce(m[i], 0) AS DOUBLE) / n END) AS vector FROM conversations c LEFT JOIN n USING (conv_id, turn)""")
def text_embedding(spark, sf_dir):
    docs = t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return models.dispatch(docs, "TextEmbeddingTask", "offline", ["text"], "vector").select("conv_id", "turn", "vector")
