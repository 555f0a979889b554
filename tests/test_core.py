import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline import queries  # noqa: F401  registers operators
from weftline.functions import es5
from weftline.operators import documents, lifting, models, vectors
from weftline.plans import graph as g
from weftline.sources import kv
from weftline.streaming import jobs


def op(name, fn, inputs=("input",), outputs=("output",), array=()):
    return g.Operator(name, fn, [g.Port(i, "number", i in array, 0) for i in inputs], [g.Port(o, "number") for o in outputs])


SQUARE = g.register(op("Square", lambda input: {"output": input**2}))
DOUBLE = g.register(op("Double", lambda input: {"output": input * 2}))
ADD = g.register(op("Add", lambda a, b: {"output": a + b}, ("a", "b")))
SUM = g.register(op("Sum", lambda input: {"output": sum(input)}, array=("input",)))


def test_graph_runs_in_layers_and_merges_provenance():
    graph = g.TaskGraph()
    graph.add_task(g.Task("s", SQUARE, {"input": 5}, {"model": "m1"})).add_task(g.Task("d", DOUBLE, {"input": 5}, {"kind": "x"})).add_task(g.Task("a", ADD))
    graph.add_flow(g.DataFlow("s", "output", "a", "a")).add_flow(g.DataFlow("d", "output", "a", "b"))
    assert graph.layers() == [["s", "d"], ["a"]]
    assert graph.run({"run": 1}) == [{"output": 35}]
    assert graph.provenance["a"] == {"run": 1, "model": "m1", "kind": "x"}
    assert [f.id for f in graph.flows] == ["s.output -> a.a", "d.output -> a.b"]
    again = g.TaskGraph.from_json(graph.to_json())
    assert again.to_json() == graph.to_json()
    assert g.TaskGraph.from_dependency_json(graph.to_dependency_json()).run() == [{"output": 35}]


def test_graph_rejects_cycles_and_bad_json():
    graph = g.serial([g.Task(x, SQUARE) for x in "abc"], "output", "input")
    with pytest.raises(g.GraphError, match="cycle"):
        graph.add_flow(g.DataFlow("c", "output", "a", "input"))
    assert len(graph.flows) == 2
    for bad, text in (({"type": "Square"}, "Task id required"), ({"id": "1"}, "Task type required"), ({"id": "1", "type": "No"}, "Task type No not found"), ({"id": "1", "type": "Square", "dependencies": {"input": {"id": "9", "output": "output"}}}, "Dependency id 9 not found")):
        with pytest.raises(g.GraphError, match=text):
            g.TaskGraph.from_dependency_json(bad)


def test_failure_aborts_the_rest():
    graph = g.serial([g.Task("a", op("Bad", lambda input: 1 / 0)), g.Task("b", SQUARE)], "output", "input")
    with pytest.raises(g.GraphError, match="layer 0"):
        graph.run()
    assert graph.tasks["b"].status == "ABORTED"


def test_builder_connects_renames_and_memoises():
    b = g.Builder().add("Square", input=3).add("Double")
    memo = g.Memo()
    assert b.run(memo=memo) == [{"output": 18}] and b.run(memo=memo) == [{"output": 18}] and memo.hits == 2
    b = g.Builder().add("Square", input=3).rename("output", "a").add("Add", b=1)
    assert b.run() == [{"output": 10}]
    arr = g.TaskGraph().add_task(g.Task("x", SQUARE, {"input": 2})).add_task(g.Task("y", SQUARE, {"input": 3})).add_task(g.Task("s", SUM, {"input": [1]}))
    arr.add_flow(g.DataFlow("x", "output", "s", "input")).add_flow(g.DataFlow("y", "output", "s", "input"))
    assert arr.run() == [{"output": 14}]
    p = g.Builder().parallel(lambda b: b.add("Square", input=2), lambda b: b.add("Double", input=2))
    assert p.run() == [{"outputs": [{"output": 4}, {"output": 4}]}]


def test_type_check(spark):
    with pytest.raises(g.GraphError, match="not number"):
        g.TaskGraph().add_task(g.Task("a", SQUARE, {"input": "x"})).run()


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id int, embedding array<double>")
    rows = vectors.top_k(df, [1.0, 0.0], 2).collect()
    assert [r.vec_id for r in rows] == [2, 3] and rows[0].score == 1.0
    assert len(vectors.top_k(df, [1.0, 0.0], None).collect()) == 3
    assert df.select(vectors.magnitude(F.col("embedding")).alias("m")).first().m == 5.0
    with pytest.raises(Exception, match="no direction"):
        spark.createDataFrame([([0.0],)], "v array<double>").select(vectors.normalize(F.col("v"))).collect()


def test_lifting_counts_empty_as_one(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, [], [3])], "id int, x array<string>, y array<int>")
    got = [(r.id, r.x, r.y, r.child) for r in lifting.combinations(df, ["x", "y"]).orderBy("id", "child").collect()]
    assert got == [(1, "a", 1, 1), (1, "a", 2, 2), (1, "b", 1, 3), (1, "b", 2, 4), (2, None, 3, 1)]


def test_markdown(spark):
    text = "intro\n# A\ntext ![alt](src.png) tail\n## B\n| a | b |\n| 1 | 2 |\n\n# C\n"
    rows = documents.markdown_fragments(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("ord", "kind").collect()
    assert [(r.kind, r.content, r.section, r.depth) for r in rows if r.kind != "image" and r.content not in ("text", "tail")] == [("text", "intro", 0, 0), ("header", "A", 1, 1), ("header", "B", 2, 2), ("table", "| a | b |\n| 1 | 2 |", 2, 2), ("header", "C", 3, 1)]
    assert [(r.alt, r.src) for r in rows if r.kind == "image"] == [("alt", "src.png")]


def test_kv(spark):
    table = kv.KVTable(spark.createDataFrame([("a", "s", 1), ("b", "s", 2)], "name string, type string, v int"), ["name", "type"], ["v"])
    table = table.put(spark.createDataFrame([("a", "s", 9), ("c", "t", 3)], "name string, type string, v int"))
    assert {(r.name, r.v) for r in table.get_all().collect()} == {("a", 9), ("b", 2), ("c", 3)}
    assert table.get({"name": "a", "type": "s"}).first().v == 9 and table.search({"v": 2}).count() == 1
    assert table.delete({"name": "a", "type": "s"}).size().first().size == 2
    with pytest.raises(ValueError):
        table.search({"type": "s"})
    with pytest.raises(ValueError):
        kv.KVTable(table.df, ["nope"])


def test_jobs(spark):
    assert jobs.admit([0, 1, 2, 3, 10, 11], 3, 10) == [True, True, True, False, True, True]
    rows = spark.createDataFrame([("q", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 3, 10, 11])], "queue string, id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.admitted for r in jobs.replay_limiter(rows, "queue", "ts", "id", 3, 10).collect()}
    assert [got[i] for i in range(6)] == [True, True, True, False, True, True]
    states = spark.createDataFrame([(None, False, 0), ("e", True, 0), ("e", True, 2), ("e", False, 0)], "error string, retryable boolean, retries int")
    out = [r[0] for r in states.select(jobs.completed_status(F.col("error"), F.col("retryable"), F.col("retries"), F.lit(3))).collect()]
    assert out == ["COMPLETED", "NEW", "FAILED", "FAILED"]


def test_streaming_windows(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:0{m}:30", "a") for m in (0, 0, 1, 7)], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.windowed_counts(stream, "ts", "k", "5 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 3]


def test_es5(spark):
    s = F.lit("  Hello World ")
    row = spark.range(1).select(es5.trim(s).alias("t"), es5.index_of(s, F.lit("o")).alias("i"), es5.last_index_of(s, "o").alias("l"), es5.slice_text(F.lit("abcdef"), -3, -1).alias("sl"), es5.substring(F.lit("abcdef"), 4, 1).alias("su"), es5.parse_int(F.lit(" 42px")).alias("pi"), es5.parse_float(F.lit("3.5e1x")).alias("pf"), es5.round_half_up(F.lit(-2.5)).alias("r"), es5.to_int32(F.lit(4294967295)).alias("n"), es5.array_join(es5.sort_as_text(F.array(F.lit(10), F.lit(9), F.lit(1)))).alias("so"), es5.to_radix(F.lit(255), 16).alias("hex"), es5.to_fixed(F.lit(1.005), 1).alias("fx")).first()
    assert (row.t, row.i, row.l, row.sl, row.su, row.pi, row.pf, row.r, row.n, row.so, row.hex, row.fx) == ("Hello World", 6, 9, "de", "bcd", 42, 35.0, -2, -1, "1,10,9", "ff", "1.0")


def test_models(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "text string")
    rows = models.dispatch(df, "TextEmbeddingTask", "offline", ["text"], "v").collect()
    assert math.isclose(sum(x * x for x in rows[0].v), 1.0) and len(rows[2].v) == 64 and rows[1].v == [0.0] * 64
    with pytest.raises(KeyError):
        models.dispatch(df, "TextEmbeddingTask", "nobody", ["text"], "v")
    one = spark.createDataFrame([("the  cat sat. The dog ran away!", "who ran", "fix", "en", "fr")], "t string, q string, p string, a string, b string")
    run = lambda task, *cols: models.dispatch(one, task, "offline", [*cols], "out").first().out
    assert run("TextSummaryTask", "t") == "the  cat sat. " and run("TextQuestionAnswerTask", "t", "q") == "The dog ran away!" and run("TextRewriterTask", "t", "p") == "The cat sat. The dog ran away!"
    assert run("TextTranslationTask", "t", "a", "b").startswith("[en>fr] the") and run("TextGenerationTask", "t").endswith("! The dog ran away!")
    with pytest.raises(Exception, match="came out"):
        models.dispatch(spark.createDataFrame([("Same.", None)], "t string, p string"), "TextRewriterTask", "offline", ["t", "p"], "o").collect()
    models.register("Twice", "python", lambda batches, model: (pdf.iloc[:, 0] * 2 for pdf in batches), "long")
    assert [r.x for r in models.dispatch(spark.range(3), "Twice", "python", ["id"], "x").collect()] == [0, 2, 4]
    loads = []
    assert models.loaded("m", loads.append) is models.loaded("m", loads.append) and loads == ["m"]
    catalog, seen = kv.seeds(spark), []
    assert {r.name: r.embedding_model for r in models.download(catalog, seen.append).collect()} == {"offline-embed-64": "offline-embed-64", "offline-text": None} and len(seen) == 2
    jobs_df = spark.createDataFrame([("1", "x", "offline-text")], "id string, text string, model string")
    assert models.job_rows(jobs_df, "TextSummaryTask", catalog.models, ["offline"], ["text"]).first().queue == "offline"
    for bad, queue in ((jobs_df.withColumn("model", F.lit("no")), "offline"), (jobs_df.withColumn("model", F.lit(None).cast("string")), "offline"), (jobs_df, "other")):
        with pytest.raises(Exception, match="no "):
            models.job_rows(bad, "T", catalog.models, [queue], ["text"]).collect()


def test_queue_as_a_task(spark):
    from weftline.streaming import queue as q

    operator = models.queue_operator("Upper", q.JobQueue(spark, "q", str.upper))
    rows = operator.run(rows=spark.createDataFrame([("1", "a"), ("2", "b")], "id string, input string"))["rows"]
    assert {(r.id, r.status, r.output) for r in rows.collect()} == {("1", "COMPLETED", "A"), ("2", "COMPLETED", "B")}


def test_lifted_operators():
    lifted = lifting.lift(ADD, ["a", "b"])
    assert lifted.run(a=[1, 2], b=[10, 20]) == {"output": [11, 21, 12, 22]} and lifted.run(a=1, b=2) == {"output": 3}
    graph = g.TaskGraph().add_task(g.Task("l", lifting.lift(SQUARE, ["input"]), {"input": [6, 7]}))
    assert graph.run() == [{"output": [36, 49]}] and "children" not in str(graph.to_json())
    assert lifting.children("t", 2) == ["t-child-1", "t-child-2"]


def test_documents_of_all_kinds(spark):
    text = "zeta ![a](b) alpha\n| x | y |\nz | w\n## deep\nbody\n# top\n"
    df = spark.createDataFrame([(1, text, "T"), (1, "other\n\nlines", None), (2, None, "")], "doc_id int, text string, title string")
    rows = documents.markdown_fragments(df.limit(1), title_col="title").orderBy("ord", "piece").collect()
    assert [(r.kind, r.content, r.path) for r in rows] == [("title", "T", []), ("text", "zeta", []), ("image", "![a](b)", []), ("text", "alpha", []), ("table", "| x | y |\nz | w", []), ("header", "deep", [1]), ("text", "body", [1]), ("header", "top", [2])]
    texts = [r.texts for r in documents.split_texts(df).collect()]
    assert texts == [["zeta", '{"alt":"a","src":"b"}', "alpha", "| x | y |\nz | w", "deep", "body", "top"], ["other\n\nlines"], []]
    compat = documents.fold("| a | b |\n| 1 | 2 |", "T", True)
    assert [(f["kind"], f["content"]) for f in compat] == [("text", "T"), ("table", "| a | b |\n| 1 | 2 |"), ("table", "| 1 | 2 |")]
    doc = documents.Document("t").add_text("a").add_image("alt", "src")
    doc.add_section("S").add_content("inside").add_section("deeper").add_table("| x |")
    out = doc.to_df(spark).orderBy("ord").collect()
    assert [(r.kind, r.path) for r in out] == [("text", []), ("image", []), ("header", [1]), ("text", [1]), ("header", [1, 2]), ("table", [1, 2])]
    with pytest.raises(ValueError):
        doc.add_content(5)
    master = documents.MasterDocument.of_markdown(df, lang="en").add_variant("sentences", documents.sentences(df), kind="x")
    assert master.metadata == {"lang": "en", "kind": "x"} and master.variant("paragraphs").filter("doc_id = 1 and content = 'lines'").count() == 1
    with pytest.raises(KeyError):
        master.variant("tree")
    assert documents.plain_fragments(df).count() == 3


def test_table_layers(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    assert {r.id: r.layer for r in g.table_layers(n, e).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_entry_names():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {*sql} <= {*q} and queries.FLAGSHIP in q


def test_parallel_keeps_edges_and_json_round_trips():
    b = g.Builder().parallel(lambda b: b.add("Square", input=3).add("Double"), lambda b: b.Double(input=1))
    assert b.run() == [{"outputs": [{"output": 18}]}] and b.graph.run(sinks=True) == [{"outputs": [{"output": 18}, {"output": 2}]}]
    again = g.TaskGraph.from_json(b.to_json())
    assert again.to_json() == b.to_json() and again.run() == b.run()
    assert g.TaskGraph.from_dependency_json(b.to_dependency_json()).run() == b.run()


def test_events_abort_reactive_and_json_task():
    seen = []
    graph = g.serial([g.Task("a", SQUARE, {"input": 2}), g.Task("b", DOUBLE)], "output", "input")
    graph.tasks["a"].on("complete", lambda out: seen.append(out))
    graph.tasks["a"].on("complete", lambda out: graph.abort())
    with pytest.raises(g.Aborted):
        graph.run()
    assert seen == [{"output": 4}] and graph.tasks["b"].status == "ABORTED"
    assert [t.id for t in graph.source_tasks("b")] == ["a"] and [t.id for t in graph.target_tasks("a")] == ["b"]
    quick = g.Operator("Quick", lambda input: {"output": 1}, [g.Port("input", "number", False, 0)], [g.Port("output", "number")], reactive=lambda out, input: {"output": input + 0.5})
    graph = g.serial([g.Task("a", quick, {"input": 2}), g.Task("b", SQUARE), g.Task("c", quick)], "output", "input")
    assert graph.run_reactive() == [{"output": None}] or graph.tasks["b"].output == {}
    runner = g.JsonRunner()
    text = '[{"id": "1", "type": "Square", "input": {"input": 4}}, {"id": "2", "type": "Double", "dependencies": {"input": {"id": "1", "output": "output"}}}]'
    assert runner(text) == runner(text) == {"outputs": [{"output": 32}]} and runner.parsed == 1
    queues = g.QueueRegistry()
    queues.register("q", seen)
    assert queues.get("q") is seen and queues.get("x") is None
    with pytest.raises(g.GraphError):
        g.Builder().add("Square").rename("output", "a", 4)


def test_any_ports_flatten_one_level():
    any_op = g.Operator("Any", lambda x: {"x": x}, [g.Port("x", "any", False, [1])], [g.Port("x")])
    assert g.Task("t", any_op).run(x=[2, [3]]) == {"x": [1, 2, [3]]}
    task = g.Task("t", op("S", lambda input: {"output": input}, array=("input",)), {"input": [1]})
    task.merged([("input", [5])])
    assert task.input == {"input": [1]}


def test_stores(spark, tmp_path):
    from weftline.sources import stores

    schema = "name string, type string, option string, success boolean"
    rows = spark.createDataFrame([("key1", "string1", "value", True), ("key2", "string1", None, False), ("key1", "string1", "older", False)], schema)
    for store in (stores.ParquetKV(spark, str(tmp_path / "p"), schema, ["name", "type"], ["option"]), stores.SqliteKV(spark, str(tmp_path / "s.db"), "kv", ["name", "type"], ["option"])):
        store.put(rows)
        assert store.size() == 2 and {(r.option, r.success) for r in store.get({"name": "key1", "type": "string1"}).collect()} == {("value", True)}
        assert store.get({"name": "x", "type": "y"}).count() == 0 and store.search({"option": "value"}).count() == 1
        store.put(rows.limit(1).select("name", "type", F.lit("new").alias("option"), "success"))
        assert store.get({"name": "key1", "type": "string1"}).first().option == "new"
        store.delete({"name": "key1", "type": "string1"})
        assert store.size() == 1 and store.get_all().first().name == "key2"
        store.delete_all()
        assert store.size() == 0
    files = stores.FileKV(spark, str(tmp_path / "f"), schema, ["name", "type"])
    assert files.size() == 0
    files.put(rows)
    assert files.size() == 2 and [tuple(r) for r in files.get({"name": "key1", "type": "string1"}).collect()] == [("value", True)]
    files.delete({"name": "key1", "type": "string1"})
    assert files.get({"name": "key1", "type": "string1"}).count() == 0 and files.get_all().columns == ["option", "success"]
    with pytest.raises(NotImplementedError):
        files.search({})
    assert stores.JdbcKV(spark, "jdbc:x", "t", ["k"], ["v"]).merge_statement() == 'INSERT INTO "t" ("k", "v") SELECT "k", "v" FROM "t_staged" ON CONFLICT ("k") DO UPDATE SET "v" = excluded."v"'


def test_simple_keys_and_repositories(spark, tmp_path):
    from weftline.sources import stores

    table = kv.KVTable(spark.createDataFrame([], "key string, value string"), ["key"]).put_one("key1", "value1")
    assert table.get_value("key1") == "value1" and table.get_value("no") is None and table.delete("key1").size().first()[0] == 0
    two = kv.KVTable(spark.createDataFrame([(None, 1, 2)], "a string, b int, c int"), ["a", "b"])
    assert two.put_one({"a": None, "b": 1}, {"c": 3}).get_all().collect() == [(None, 1, 3)]
    assert two.separate({"a": 1, "b": 2, "c": 3}) == ({"a": 1, "b": 2}, {"c": 3})
    for bad in (lambda: two.get_value("x"), lambda: two.get("x"), lambda: two.put_one({"a": 1}, {"c": 1}), lambda: kv.checked_names("bad name", [], []), lambda: kv.checked_names("t", ["a"], ["a"])):
        with pytest.raises(ValueError):
            bad()
    outputs = stores.TaskOutputRepository.at(spark, str(tmp_path / "o"))
    outputs.save("taskType1", {"id": "task1", "deep": {"b": 1, "a": 2}}, {"result": "success"})
    assert outputs.get("taskType1", {"deep": {"a": 2, "b": 1}, "id": "task1"}) == {"result": "success"}
    assert outputs.get("taskType1", {"id": "task2"}) is None and outputs.get("other", {"id": "task1"}) is None and outputs.size() == 1
    graphs = stores.TaskGraphRepository.at(spark, str(tmp_path / "g"))
    graph = g.serial([g.Task("a", SQUARE, {"input": 2}), g.Task("b", DOUBLE)], "output", "input")
    graphs.save("g1", graph)
    assert graphs.get("g1").to_json() == graph.to_json() and graphs.get("g2") is None
    graphs.clear()
    assert graphs.size() == 0


def test_catalog_writes(spark):
    catalog = kv.seeds(spark)
    catalog = catalog.add_models(spark.createDataFrame([("m", "offline", 3, False)], catalog.models.schema)).connect(spark.createDataFrame([("TextSummaryTask", "m"), ("TextSummaryTask", "m")], "task string, model string"))
    assert catalog.size().first()[0] == 3 and catalog.models_by_task("TextSummaryTask").count() == 2 and catalog.by_name("m").count() == 1
    rows = {r.name: r for r in catalog.ports({"embedding_model": "TextEmbeddingTask", "summarization_model": "TextSummaryTask"}).collect()}
    assert rows["m"].embedding_model is None and rows["m"].summarization_model == "m" and rows["offline-embed-64"].embedding_model == "offline-embed-64"
    kv.set_catalog(catalog)
    assert kv.get_catalog() is catalog


def test_table_layers_of_cycles_and_depth(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(8)], "source string, target string")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(9)], "id string")
    assert {r.id: r.layer for r in g.table_layers(nodes, chain).collect()} == {f"n{i:02d}": i for i in range(9)}
    with pytest.raises(g.GraphError, match="cycle"):
        g.table_layers(nodes, chain.union(spark.createDataFrame([("x", "y"), ("y", "x")], chain.schema)))


def test_queue_runs_retries_aborts_and_limits(spark):
    from datetime import datetime, timedelta

    from weftline.streaming import queue as q

    now = datetime(2024, 1, 1)

    def work(text):
        if text.startswith("retry"):
            raise q.RetryableJobError("later", 60)
        if text.startswith("bad"):
            raise ValueError("broken")
        return text.replace("input", "output", 1)

    jobs = q.JobQueue(spark, "q", work).start()
    jobs.add(spark.createDataFrame([("a", "input1", "r1", 10, None), ("b", "retry", "r1", 2, None), ("c", "bad", "r2", 10, None), ("d", "input2", "r2", 10, now - timedelta(days=1))], "id string, input string, jobRunId string, maxRetries int, deadlineAt timestamp"), now)
    assert jobs.size() == 4 and jobs.by_run("r1").count() == 2 and jobs.process(now) == 4
    state = {r.id: r for r in jobs.jobs.collect()}
    assert (state["a"].status, state["a"].output, state["a"].progress, state["a"].retries) == ("COMPLETED", "output1", 100.0, 0)
    assert (state["b"].status, state["b"].retries, state["b"].runAfter) == ("NEW", 1, now + timedelta(seconds=60))
    assert (state["c"].status, state["c"].errorCode) == ("FAILED", q.PERMANENT) and "deadline" in state["d"].error
    assert jobs.output_for_input("input1") == "output1" and jobs.output_for_input("x") is None
    assert jobs.process(now) == 0 and jobs.peek(now=now).first().id == "b" and jobs.process(now + timedelta(seconds=60)) == 1
    assert jobs.get("b").first().status == "FAILED"
    assert jobs.wait_for("a") == "output1"
    with pytest.raises(q.PermanentJobError, match="broken"):
        jobs.wait_for("c")
    row = jobs.stats().first()
    assert (row.total, row.completed, row.failed, row.aborted, row.retried) == (4, 1, 3, 0, 1)
    with pytest.raises(Exception, match="COMPLETED"):
        jobs.update_progress(spark.createDataFrame([("a", 10.0, "m", None)], "id string, progress double, message string, details string"))

    jobs.clear().add(spark.createDataFrame([(x, "input", run) for x, run in (("1", "run-1"), ("2", "run-1"), ("3", "run-2"))], "id string, input string, jobRunId string"), now)
    assert [r.id for r in jobs.claim(1, now).collect()] == ["1"]
    jobs.update_progress(spark.createDataFrame([("1", 150.0, "Halfway there", None), ("2", -10.0, "x", None)], "id string, progress double, message string, details string"))
    assert {r.id: r.progress for r in jobs.jobs.collect()} == {"1": 100.0, "2": 0.0, "3": 0.0}
    jobs.abort_run("run-1", now)
    assert {r.id: r.status for r in jobs.jobs.collect()} == {"1": "ABORTING", "2": "FAILED", "3": "NEW"}
    jobs.complete(spark.createDataFrame([("1", "late", None, None, None)], q.RESULTS), now)
    assert {r.id: (r.status, r.errorCode) for r in jobs.jobs.collect()} == {"1": ("FAILED", q.ABORT), "2": ("FAILED", q.ABORT), "3": ("NEW", None)}
    with pytest.raises(q.AbortSignalJobError):
        jobs.wait_for("2")
    jobs.stop()
    assert jobs.process(now) == 0 and jobs.restart().size() == 0

    rate = q.JobQueue(spark, "q", work, q.RateLimiter(4, 1))
    rate.add(spark.createDataFrame([(f"{i:02d}", "input") for i in range(15)], "id string, input string"), now)
    assert rate.process(now) == 4 and rate.process(now) == 0 and rate.get("14").first().status == "NEW"
    assert rate.limiter.next_time(now) == now + timedelta(minutes=1) and rate.process(now + timedelta(minutes=1)) == 4


def test_limiters():
    from datetime import datetime, timedelta

    from weftline.streaming import queue as q

    now, ms = datetime(2024, 1, 1), lambda n: timedelta(milliseconds=n)
    c = q.ConcurrencyLimiter(2)
    c.record_start(now)
    assert not c.can_proceed(now) and c.can_proceed(now + ms(1000))
    c.record_start(now + ms(1000))
    assert not c.can_proceed(now + ms(5000))
    c.record_completion(now + ms(5000))
    assert c.can_proceed(now + ms(5000))
    d = q.DelayLimiter()
    d.record_start(now)
    assert not d.can_proceed(now + ms(49)) and d.can_proceed(now + ms(50))
    both = q.CompositeLimiter([d, q.RateLimiter(1, 1)])
    both.record_start(now)
    assert not both.can_proceed(now + ms(60)) and both.next_time(now) == now + timedelta(minutes=1)
    both.clear()
    assert both.can_proceed(now)


def test_vector_checks_and_pooling(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], True, True)], "a array<double>, b array<double>, na boolean, nb boolean")
    assert vectors.checked_vectors(df, ["a", "b"], ["na", "nb"]).count() == 1
    for bad in (df.withColumn("b", F.array(F.lit(1.0))), df.withColumn("a", F.array().cast("array<double>")), df.withColumn("nb", F.lit(False))):
        with pytest.raises(Exception, match="vector"):
            vectors.checked_vectors(bad, ["a", "b"], ["na", "nb"]).collect()
    assert df.select(vectors.mean_pooled(F.array("a", "b")).alias("m")).first().m == [0.5, 1.0]
    many = spark.createDataFrame([(i, [float(i % 7), 1.0 + i % 3]) for i in range(60)], "vec_id int, embedding array<double>")
    got = vectors.top_k_of_each(many, many.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 4)
    for i in range(3):
        want = [r.vec_id for r in vectors.top_k(many, many.filter(f"vec_id = {i}").first().embedding, 4).collect()]
        assert [r.vec_id for r in got.filter(f"query_id = {i}").orderBy(F.desc("score"), "vec_id").collect()] == want


def test_sinks(spark, caplog):
    from weftline.operators import sinks

    with caplog.at_level("INFO", logger="weftline"):
        assert sinks.logged(spark.range(2)).count() == 2 and "id" in caplog.text
    with pytest.raises(ValueError, match="No runner provided"):
        sinks.applied(None)
    assert sinks.applied(lambda x: x + 1, 2) == 3 and sinks.applied(lambda d: d.filter("id > 0"), spark.range(2)).count() == 1
    out = sinks.OutputSink(lambda d: d.count())(spark.range(1), {"model": "m"})
    assert out.schema["id"].metadata == {"provenance": {"model": "m"}}


def test_es5_edge_values(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    L = F.lit  # noqa: N806
    inf, nan = float("inf"), float("nan")
    assert [value(es5.to_int32(L(x))) for x in (nan, inf, 1e20, -1.9, 4294967296.0 + 5, 2147483648.0)] == [0, 0, 1661992960, -1, 5, -2147483648]
    assert [value(es5.to_fixed(L(x), d)) for x, d in ((1.005, 2), (0.5, 0), (2.5, 0), (1.45, 1), (-1.5, 0), (10.235, 2), (3.0, 2), (0.000001, 7))] == ["1.00", "1", "3", "1.4", "-2", "10.23", "3.00", "0.0000010"]
    assert [value(es5.to_radix(L(x), r)) for x, r in ((-255, 16), (255, 2), (0, 7))] == ["-ff", "11111111", "0"]
    assert [value(es5.parse_int(L(x), r)) for x, r in (("0x1F", 0), (" 42px", 0), ("-12", 0), ("101", 2), ("z", 36), ("1f", 16))] == [31.0, 42.0, -12.0, 5.0, 35.0, 31.0]
    assert math.isnan(value(es5.parse_int(L("x"))))
    assert [value(es5.number_text(L(x))) for x in (1.0, 1e7, 0.1, 1e21, 1.5e-7, -2.5, 123456789.125, 1e-6, nan, inf, 0.0, 1.2345e20)] == ["1", "10000000", "0.1", "1e+21", "1.5e-7", "-2.5", "123456789.125", "0.000001", "NaN", "Infinity", "0", "123450000000000000000"]
    nums = F.array(*[L(x) for x in (10.0, 9.0, 1.0, 1e7)])
    assert value(es5.array_join(es5.sort_as_text(nums, "double"), ",", "double")) == "1,10,10000000,9"
    assert [value(es5.number_of(L(x))) for x in ("", " 12 ", "0x10", "1e3")] == [0.0, 12.0, 16.0, 1000.0] and math.isnan(value(es5.number_of(L("1x"))))
    assert value(es5.add(L(1.0), L("a"), "double", "string")) == "1a" and value(es5.add(L(1), L(2), "int", "int")) == 3.0
    assert value(es5.divide(L(1), L(0))) == inf and math.isnan(value(es5.remainder(L(5), L(0)))) and value(es5.remainder(L(-5), L(3))) == -2.0
    assert [value(es5.loosely_equal(L("1"), L(1.0), "string", "double")), value(es5.strictly_equal(L("1"), L(1.0), "string", "double")), value(es5.strictly_equal(L(1), L(1.0), "int", "double")), value(es5.strictly_equal(L(nan), L(nan), "double", "double"))] == [True, False, True, False]
    assert value(es5.char_code_at(L("a🙂"), 1)) == 0xD83D and value(es5.utf16_length(L("a🙂"))) == 3
    assert value(es5.from_char_code(F.array(L(0xD83D), L(0xDE42), L(65)))) == "🙂A"
    assert value(es5.encode_uri_component(L("a b&é/"))) == "a%20b%26%C3%A9%2F" and value(es5.encode_uri(L("a b&é/"))) == "a%20b&%C3%A9/"
    assert value(es5.decode_uri_component(L("a%20b%26%C3%A9+"))) == "a b&é+" and value(es5.decode_uri(L("a%20b%26"))) == "a b%26"
    assert value(es5.escape(L("é 漢a"))) == "%E9%20%u6F22a" and value(es5.unescape(L("%E9%20%u6F22a%"))) == "é 漢a%"
    assert value(es5.replace(L("aXbXc"), "X(.)", "<$1>")) == "aA".replace("A", "<b>") + "Xc" and value(es5.replace(L("aXbxc"), "x", "-", "gi")) == "a-b-c" and value(es5.replace(L("aXbxc"), "x", "-", "i")) == "a-bxc"
    assert value(es5.exec(L("k=v"), r"(\w)=(\w)")) == ["k=v", "k", "v"] and value(es5.test(L("ABC"), "b", "i"))
    arr = F.array(L(3), L(1), L(2), L(1))
    assert value(es5.array_index_of(arr, L(1), 2)) == 3 and value(es5.array_last_index_of(arr, L(1))) == 3 and value(es5.array_index_of(arr, L(9))) == -1
    assert [value(c) for c in es5.pop(arr)] == [1, [3, 1, 2]] and [value(c) for c in es5.shift(arr)] == [3, [1, 2, 1]]
    assert [value(c) for c in es5.push(arr, L(7))] == [5, [3, 1, 2, 1, 7]] and [value(c) for c in es5.unshift(arr, L(7))] == [5, [7, 3, 1, 2, 1]]
    assert value(es5.fold_right(arr, L(""), lambda t, x: F.concat(t, x.cast("string")))) == "1213" and value(es5.fold_first(arr, lambda t, x: t - x)) == -1
    with pytest.raises(Exception, match="nothing to begin"):
        value(es5.fold_first(F.array().cast("array<int>"), lambda t, x: t + x))
    assert value(es5.date_utc(L(2024), L(13), L(1))) == 1738368000000 and value(es5.iso(es5.date_set(F.to_timestamp(L("2024-01-31 10:00:00")), "month", L(1)))) == "2024-03-02T10:00:00.000Z"
    assert [value(es5.to_precision(L(x), p)) for x, p in ((123.456, 4), (0.000123, 2), (1e21, 3), (1234.5, 2))] == ["123.5", "0.00012", "1.00e+21", "1.2e+3"] and value(es5.to_exponential(L(12345.0), 2)) == "1.23e+4"
    assert math.isnan(value(es5.minimum(L(1.0), L(nan)))) and value(es5.maximum(L(1.0), L(3.0))) == 3.0 and value(es5.MATH["log"](L(0.0))) == -inf
    assert value(es5.substr(L("abcdef"), -3, 2)) == "de" and value(es5.locale_compare(L("a"), L("b"))) == -1 and es5.type_of("int") == "number"
    assert value(es5.without_key(F.create_map(L("a"), L(1), L("b"), L(2)), "a")) == {"b": 2} and value(es5.is_finite(L(inf))) is False


@pytest.mark.parametrize("code, want", [
    ("1 + 2 * 3 - 4 / 2 % 3", 5), ("'a' + 1 + 2", "a12"), ("var a = [3, 1, 10]; a.sort().join('-')", "1-10-3"), ("var s = 0; for (var i = 0; i < 5; i++) { if (i == 3) continue; s += i; } s", 7),
    ("function f(n) { return n < 2 ? n : f(n - 1) + f(n - 2); } f(10)", 55), ("var o = {a: 1, 'b c': [2]}; delete o.a; Object.keys(o)", ["b c"]), ("typeof nope + typeof 1 + typeof null", "undefinednumberobject"),
    ("try { null.x } catch (e) { e.name }", "TypeError"), ("try { throw new RangeError('far') } catch (e) { e instanceof Error && e.message } finally { var z = 1 }", "far"), ("(5).toFixed(2) + (1.005).toFixed(2) + (255).toString(16) + (-255).toString(16)", "5.001.00ff-ff"),
    ("switch (3) { case 1: 'a'; break; case 3: var r = 'c'; default: r += 'd' } r", "cd"), ("outer: for (var i = 0; i < 3; i++) for (var j = 0; j < 3; j++) if (j == 1) continue outer; else if (i == 2) break outer; i + ':' + j", "2:0"),
    ("'a-b-c'.replace(/-/g, function (m, at) { return at; }) + 'xyz'.replace('y', '[$&]')", "a1b3cx[y]z"), ("/(\\w)(\\d)/.exec('x a1').slice(1)", ["a", "1"]), ("'aXbX'.split('X')", ["a", "b", ""]), ("[1, [2, 3]].concat([4], 5).length", 4),
    ("[1, 2, 3].map(function (x) { return x * x }).filter(function (x) { return x > 1 }).reduce(function (a, b) { return a + b })", 13), ("JSON.stringify({a: [1, 'x', null, undefined], b: undefined})", '{"a":[1,"x",null,null]}'), ("JSON.parse('{\"k\": [1, 2]}').k[1]", 2),
    ("1e20 | 0", 1661992960), ("NaN | 0", 0), ("-1 >>> 28", 15), ("'5' * '2' == 10 && '5' === 5", False), ("null == undefined && null !== undefined", True), ("0 || 'x' && 'y'", "y"), ("new Date(0).toISOString()", "1970-01-01T00:00:00.000Z"),
    ("new Date(Date.UTC(2024, 1, 30)).getUTCDate()", 1), ("encodeURIComponent('a b&é') + escape('漢')", "a%20b%26%C3%A9%u6F22"), ("parseInt('0x1F') + parseInt('12px') + parseFloat('3.5e1x')", 78), ("Math.max(1, 3, 2) + Math.round(-2.5)", 1), ("isNaN('x') && !isFinite(1 / 0)", True),
    ("var c = 0; do { c++ } while (c < 4); var k = ''; for (var p in {x: 1, y: 2}) k += p; k + c", "xy4"), ("function P(n) { this.n = n } P.prototype.get = function () { return this.n }; new P(7).get()", 7), ("(function () { return arguments.length }).call(null, 1, 2)", 2),
    ("var x = 1; x += 2; x <<= 3; x ^= 1; x--; x", 24), ("input.a + input.list[1]", 12), ("String.fromCharCode(72, 105) + 'abc'.charCodeAt(1)", "Hi98"), ("[3, 2, 1].indexOf(1) + 'hello'.lastIndexOf('l')", 5), ("void 0", None), ("1 in [5, 6] && 'a' in {a: 1}", True),
    ("var f = function () { return this.v }.bind({v: 4}); f()", 4), ("// note\n/* more */ 1, 2", 2), ("'abc'.substr(-2, 1) + 'abc'.substring(2, 0) + 'abc'.slice(-1)", "babc"), ("[1,2,3,4].splice(1, 2)", [2, 3]), ("0.1 + 0.2", 0.30000000000000004), ("1e21 + ''", "1e+21"),
])
def test_scripts(code, want):
    from weftline.functions import script

    got = script.evaluate(code, {"a": 10, "list": [1, 2]})
    assert got == want and type(got) is type(want)


def test_script_errors_and_table(spark):
    from weftline.functions import script

    for bad in ("eval('1')", "new Function('1')", "nope()", "throw 'x'"):
        with pytest.raises(script.Thrown):
            script.evaluate(bad)
    for bad in ("1 +", "while (true) {}", "var = 3", "function f() { return f() } f()"):
        with pytest.raises((script.ScriptError, script.Thrown)):
            script.evaluate(bad, None, 10_000)
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    rows = script.javascript(df, "if (input.s === null) throw new Error('empty'); ({s: input.s + input.n})", ["n", "s"]).orderBy("n").collect()
    assert [(r.output, r.error) for r in rows] == [('{"s":"a1"}', None), (None, "empty")]
    with pytest.raises(script.ScriptError):
        script.javascript(df, "1 +", ["n"])
