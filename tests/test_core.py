"""Operators against hand-computed values, and registered queries against their SQL."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from cellwright import queries
from cellwright.operators import clients, clustering, dependencies, features, fewshot, labelling, metrics, profile, prompts
from cellwright.plans import experiments
from cellwright.sources import datasets, results
from cellwright.streaming import checks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(df, con, sql):
    a, b = df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    text = lambda v: "null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)
    rows = lambda d: sorted(tuple(text(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(a) == rows(b)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, con, name):
    same_rows(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "toy"
    d.mkdir()
    clean = [("1", "a", "1.1"), ("2", "b", "2.2"), ("3", "c", "3.3"), ("4", "d", "4.4"), ("5", "e", "5.5")]
    dirty = [r if i != 2 else ("999", "x", r[2]) for i, r in enumerate(clean)]
    for name, rows in (("clean", clean), ("dirty", dirty)):
        (d / f"{name}.csv").write_text("col1,col2,col3\n" + "\n".join(",".join(r) for r in rows) + "\n")
    (d / "rule.json").write_text(json.dumps({"columns": [{"name": "col1", "data_type": "integer"}, {"name": "col2", "meaning": "letter"}]}))
    return str(tmp_path)


def test_load_and_preprocess(spark, root):
    assert datasets.available_datasets(spark, root) == ["toy"]
    assert datasets.available_datasets(spark, root + "/none") == []
    data = datasets.load_dataset(spark, root, "toy")
    assert data.dirty.count() == 5 and data.rules.count() == 2
    assert datasets.dataset_info(spark, root, "toy")["num_rules"] == 2
    ready, stats = profile.preprocess_dataset(data)
    assert stats["removed_columns"] == [] and stats["error_ratio"] == pytest.approx(2 / 15)
    bad = {(r["row_id"], r["column"]) for r in ready.labels.where("is_error").collect()}
    assert bad == {(2, "col1"), (2, "col2")}
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, root, "missing")


def test_csv_keeps_text(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b\n"say ""hi""",NA\n"two\nlines",\nnull,nan\n')
    rows = [tuple(r) for r in datasets.read_csv(spark, str(p)).collect()]
    assert rows == [('say "hi"', "NA"), ("two\nlines", ""), ("null", "nan")]


PEOPLE = [("Alice", "25", "NYC", "50000"), ("Bob", "30", "LA", "60000"), ("Charlie", "35", "Chicago", "70000"), ("Alice", "25", "NYC", "50000"), ("Bob", "30", "LA", "60000")]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(PEOPLE)], "row_id long, name string, age string, city string, salary string")


def test_fd_and_nmi_of_bijections(people):
    for r in dependencies.fd_features(people, "salary", "row_id").collect():
        if r["lhs"] == "salary":
            assert (r["support"], r["confidence"]) == (0.5, 0.5)
        else:
            assert r["support"] == pytest.approx(0.1 if r["row_id"] == 2 else 0.2) and r["confidence"] == 0.5
    assert {r["nmi"] for r in dependencies.nmi_matrix(people, ["name", "age", "city"]).collect()} == {1.0}
    with pytest.raises(ValueError):
        dependencies.fd_features(people, "none", "row_id")


def test_basic_features(spark):
    df = spark.createDataFrame([(0, "item123"), (1, "file1.txt"), (2, ""), (3, None)], "row_id long, t string")
    rows = {r["row_id"]: r for r in features.basic(df, "t", "row_id").collect()}
    assert tuple(rows[0])[1:] == (7, 3, 4, 0, 0, 0, 4, 3 / 7, 4 / 7, 0.0, 0.0)
    assert rows[1]["punct_ratio"] == pytest.approx(1 / 9)
    assert set(tuple(rows[2])[1:]) == {0} and set(tuple(rows[3])[1:]) == {0}


def test_tfidf_rows_have_unit_norm(spark):
    df = spark.createDataFrame(list(enumerate("apple banana cherry date elderberry fig grape honeydew kiwi lemon".split())), "row_id long, t string")
    found = features.char_tfidf(df, "t", "row_id").groupBy("row_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()
    assert len(found) == 10 and all(r["n"] == pytest.approx(1) for r in found)
    with pytest.raises(ValueError):
        features.char_tfidf(df.withColumn("t", F.lit("")), "t", "row_id")
    with pytest.raises(ValueError):
        features.bin_edges(features.token_frequencies(df, "t"), method="other")
    for method in ("quantile", "uniform", "log"):
        shares = features.token_bins(df, "t", "row_id", 5, method).groupBy("row_id").agg(F.sum("value").alias("s")).collect()
        assert all(r["s"] == pytest.approx(1) for r in shares)


def test_column_features_and_propagation(people):
    vec, names = features.column_features(people, "salary", "row_id")
    rows = vec.collect()
    assert len(rows) == 5 and all(len(r["vec"]) == len(names) for r in rows)
    with pytest.raises(ValueError):
        features.column_features(people.where("false"), "salary", "row_id")
    p = clustering.LabelPropagator({"salary": vec}, "row_id", clustering.SeededCentroids(3, 1))
    assigned, reps = p.sample()
    assert reps.join(assigned, (reps["rep"] == assigned["row_id"]) & (reps["cluster_id"] == assigned["cluster_id"])).count() == reps.count()
    truth = people.select("row_id", F.lit("salary").alias("column"), (F.col("row_id") == 2).alias("is_error"))
    assert p.propagate_dataset(truth).groupBy("row_id").count().where("count > 1").count() == 0
    with pytest.raises(ValueError):
        p.propagate_dataset(truth.withColumn("column", F.lit("other")))
    with pytest.raises(ValueError):
        clustering.LabelPropagator({}, "row_id")


TRUE, PRED = {"col1": [0, 1, 0, 1], "col2": [1, 0, 1, 0], "col3": [0, 0, 1, 1]}, {"col1": [0, 1, 1, 1], "col2": [1, 0, 0, 0], "col3": [0, 0, 1, 0]}


def long(spark, d):
    return spark.createDataFrame([(i, c, bool(v)) for c, x in d.items() for i, v in enumerate(x)], "row_id long, column string, is_error boolean")


def test_metrics(spark):
    e = metrics.Evaluator()
    r = e.evaluate(long(spark, TRUE), long(spark, PRED), "row_id", "toy", "m")
    assert r["overall"]["total_cells"] == 12 and r["overall"]["precision"] == pytest.approx(0.8) and r["overall"]["f1_score"] == pytest.approx(8 / 11)
    assert r["column_results"]["col1"]["f1_score"] == pytest.approx(0.8)
    assert "error" in e.evaluate(long(spark, TRUE), long(spark, {"col1": [0, 1]}), "row_id")
    assert "error" in e.evaluate(long(spark, TRUE), long(spark, {"col1": PRED["col1"], "col2": PRED["col2"], "other": [0, 0, 0, 0]}), "row_id")
    assert len(e.history) == 1 and e.summary()["performance_level"] == "fair"
    assert any("precision" in x for x in metrics.recommendations({"precision": 0.5, "recall": 0.8}))


def test_reports(spark, tmp_path, capsys):
    r = metrics.Evaluator().evaluate(long(spark, TRUE), long(spark, PRED), "row_id", "toy")
    for kind in ("json", "html", "markdown"):
        assert metrics.write_report(r, str(tmp_path), kind).read_text()
    metrics.print_results(r)
    assert "col1" in capsys.readouterr().out
    assert json.loads(results.save_result(r, "toy", 3, 1, str(tmp_path / "out")).read_text())["dataset"] == "toy"


def test_few_shot_limits(spark):
    d = spark.createDataFrame([(i, "x" if i < 2 else "y") for i in range(6)], "row_id long, v string")
    c = d.withColumn("v", F.lit("y"))
    assert fewshot.select_few_shot(d, c, "v", "row_id", 0).count() == 0
    assert fewshot.select_few_shot(d, c, "v", "row_id", 7).count() == 0
    assert [r["v"] for r in fewshot.select_few_shot(d, c, "v", "row_id", 3).collect()] == ["x", "x", "y"]
    assert {r["v"] for r in fewshot.select_few_shot(d, c, "v", "row_id", 2, "diverse").collect()} == {"x", "y"}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ('{"labels":[{"row_id":1,"is_error":true}]}', {1: True}),
        ('Sure {"labels":[{"row_id":1,"is_error":false}]} ok', {1: False}),
        ('{"labels":[{"row_id":1,"is_error":true}]}{"labels":[{"row_id":2,"is_error":true}]}', {1: True}),
        ('{"labels":[{"row_id":1,"is_error":true},{"row_id":2,"is_error":null}]}', {}),
        ("garbage", {}),
        ('{"labels":[{"row_id":9,"is_error":true}]}', {}),
        ('{"labels":[{"row_id":1,"is_error":true},{"row_id":1,"is_error":false}]}', {1: False}),
        ('{"labels":[{"row_id":"1","is_error":"true"}]}', {1: True}),
    ],
)
def test_parse(spark, text, labels):
    known = spark.createDataFrame([(1,), (2,)], "row_id long")
    found = labelling.parse_labels(spark.createDataFrame([(0, text)], "batch long, response string"))
    assert {r["row_id"]: r["is_error"] for r in labelling.settle_labels(found, known, "row_id").collect()} == labels


def test_clients():
    f = clients.Factory()
    assert f.settings("gemma-3-4b-it", key="k")["key"] == "k" and f.models_by_api("ollama") == ["llama3.1:8b", "qwen3:4b", "qwen3:8b"]
    with pytest.raises(KeyError):
        f.create("none")
    with pytest.raises(ValueError):
        clients.create("none", "m")
    with pytest.raises(ValueError):
        clients.create("openai", "m")
    assert clients.call_policy("openai")[1] == 10.0
    assert prompts.Strategy.of(["ZS-I", "A"]) == prompts.Strategy(False, True, 0)
    with pytest.raises(KeyError):
        prompts.PromptManager().get("error_detection", "none")


def test_whole_runs(spark, root, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Yes(clients.Client):  # local, so that it travels to the workers by value
        def chat(self, messages, **how):
            import uuid

            text = messages[0]["content"]
            (calls / uuid.uuid4().hex).write_text(text)
            self.total_tokens += 7
            ids = [x["row_id"] for x in json.loads(text[text.index('{\n  "labels"') :])["labels"]]
            return json.dumps({"labels": [{"row_id": i, "is_error": i == 2} for i in ids]})

    data = datasets.load_dataset(spark, root, "toy")
    r = experiments.propagation_run(data, 5, 1, clustering.SeededCentroids(5, 1))
    assert r["overall"]["f1_score"] == 1.0
    r = experiments.detection_run(data, lambda df: clients.respond(df, lambda: Yes("yes")), ["ZS-R", "A"], 1, 5, 2, clusterer=clustering.SeededCentroids(5, 1))
    assert r["overall"]["recall"] == 1.0 and math.isfinite(r["execution_time"])
    sent = [c.read_text() for c in calls.iterdir()]
    assert len(sent) == len(set(sent)) == r["usage"]["n_prompts"] == 9  # three columns of five rows, two a prompt: each once
    assert r["usage"]["total_tokens"] == 63
    mine = [t for t in sent if "Rules for column 'col1'" in t]
    assert len(mine) == 3 and all("{'data_type': 'integer', 'meaning': nan}" in t or "{'meaning': nan, 'data_type': 'integer'}" in t for t in mine)


def test_sweep_and_command_line(spark, root, capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    ran = []

    def run(data, k, seed, clusterer=None, save=False):
        ran.append((data.name, k, seed))
        result = metrics.Evaluator().evaluate(long(spark, TRUE), long(spark, PRED), "row_id", data.name)
        return result | {"execution_time": 0.1} | ({"saved": results.save_result(result, data.name, k, seed)} if save else {})

    monkeypatch.setattr(experiments, "propagation_run", run)
    found = experiments.sweep(spark, root, ["toy", "missing"], [2], [1, 2])
    assert [(r["dataset"], r["k"], r["seed"]) for r in found] == ran == [("toy", 2, 1), ("toy", 2, 2)]
    experiments.main([root, "--dataset", "toy", "-k", "3", "--save"])
    assert ran[-1] == ("toy", 3, 114) and "col1" in capsys.readouterr().out
    assert len(list((tmp_path / "results" / "label_propagation").glob("toy_k3_seed114_*.json"))) == 1


def test_prompts_keep_braces_and_control_characters(spark):
    rows = spark.createDataFrame([(1, "say \"{column}\"\\\n\x01é", None)], "row_id long, a string, b string")
    got = prompts.batch_documents(rows, ["a", "b"], "row_id", 5).first()
    assert got["data_json"] == json.dumps([{"a": "say \"{column}\"\\\n\x01é", "b": None, "row_id": 1}], indent=2, ensure_ascii=False)
    assert got["label_json"] == json.dumps({"labels": [{"row_id": 1, "is_error": None}]}, indent=2)
    assert prompts.PromptManager().examples(rows.withColumn("clean_value", F.lit("{example_num}")), "a", "row_id").startswith("Example 1:\nRow: {'a': 'say \"{column}\"\\\\\\n\\x01é', 'b': None}\nColumn: a\n")
    whole = rows.select(prompts.PromptManager().prompt("a", F.lit("{output_json}"), F.lit("{}"), F.lit("{rules} {column}")).alias("p")).first()["p"]
    assert "Rules for column 'a':\n{rules} {column}\n" in whole and "Input:\n{output_json}\n" in whole


def test_clients_over_a_mocked_interface(monkeypatch, tmp_path):
    seen = []

    def post(url, body, headers=None, timeout=30):
        seen.append((url, body, headers))
        if url.endswith("/api/tags"):
            return {"models": [{"name": "m"}]}
        if "/models/" in url:
            if url.endswith("none"):
                raise OSError("404")
            return {"id": "m"}
        if url.endswith("/api/generate"):
            return {"response": "text"}
        if url.endswith("/api/chat"):
            return {"message": {"content": "hello"}}
        return {"choices": [{"message": {"content": "{}"}}], "usage": {"total_tokens": 5}}

    monkeypatch.setattr(clients, "post", post)
    local = clients.create("ollama", "m")
    assert local.chat([{"role": "user", "content": "x"}]) == "hello" and local.generate("x", think=False) == "text"
    assert seen[-1][1] == {"model": "m", "prompt": "x", "stream": False, "think": False} and local.model_name() == "m"
    with pytest.raises(ValueError):
        clients.create("ollama", "other")
    with pytest.raises(ValueError):
        clients.create("openai", "none", url="http://h/v1/", key="k")
    far = clients.create("openai", "m", url="http://h/v1/", key="k", measure=True)
    assert far.generate("x", temperature=0, response_format=clients.LABELS_SCHEMA) == "{}"
    url, body, headers = seen[-1]
    assert url == "http://h/v1/chat/completions" and headers == {"Authorization": "Bearer k"} and body["messages"] == [{"role": "user", "content": "x"}]
    assert body["response_format"]["json_schema"]["schema"] == clients.LABELS_SCHEMA and far.usage()["total_tokens"] == 5
    path = tmp_path / "models.json"
    path.write_text('{"models": {"m": {"api": "ollama"}}}')
    factory = clients.Factory(str(path))
    assert factory.available_models() == {"m": "ollama"} and factory.create("m").model == "m"
    path.write_text('{"models": {"n": {"api": "ollama"}}}')
    factory.reload_config()
    assert factory.available_models() == {"n": "ollama"}
    path.write_text("{")
    with pytest.raises(ValueError):
        factory.reload_config()
    with pytest.raises(FileNotFoundError):
        clients.Factory(str(tmp_path / "none.json"))


def test_row_ids_over_many_files(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text("a\n" + "".join(f"{i}-{j}\n" for j in range(7)))
    rows = datasets.with_row_id(datasets.read_csv(spark, str(tmp_path), multi_line=False)).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(35)) and len({r["a"] for r in rows}) == 35
    assert all(int(x["a"][2:]) == int(y["a"][2:]) - 1 for x, y in zip(rows, rows[1:]) if x["a"][0] == y["a"][0])  # noqa: B905


def test_missing_predictions_are_logged(spark, people, caplog):
    vec, _ = features.column_features(people, "salary", "row_id")
    p = clustering.LabelPropagator({"salary": vec, "city": vec}, "row_id", clustering.SeededCentroids(3, 1))
    labels = people.select("row_id", F.lit("salary").alias("column"), F.lit(True).alias("is_error"))
    p.propagate_column("salary", labels)
    with caplog.at_level("WARNING"):
        assert {r["column"] for r in p.prediction().collect()} == {"salary"}
    assert "city" in caplog.text
    p.forget()


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from cellwright.sources import scratch

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        scratch.shared_folder(Elsewhere())


def test_stream(spark, tmp_path):
    spark.createDataFrame([("1", "a"), ("x", "b")], "n string, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n string, t string").parquet(str(tmp_path / "in"))
    q = checks.violations_stream(checks.basic_stream(stream, "t"), {"n": {"data_type": "integer"}}).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(len(r["violations"]) for r in spark.table("seen").collect()) == [0, 1]


def test_features_and_clusters_plan_constants_as_literals(spark):
    """Scaled vectors read what was written: no join, no sum is planned again, and constants are one literal."""
    rows = spark.createDataFrame([(i, f"word{i % 5} {i}", "x" * (i % 3)) for i in range(40)], "row_id long, a string, b string")
    vectors, names = features.column_features(rows, "a", "row_id")
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "from_json" not in plan and len(vectors.first()["vec"]) == len(names)
    points = spark.createDataFrame([(1, [0.0, 0.1]), (2, [5.0, 1e-7]), (3, [2.5, 0.0])], "row_id long, vec array<double>")
    found = clustering.assign(points, [[0.0, 0.1], [5.0, 1e-7]], "row_id")
    assert "from_json" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.orderBy("row_id").collect()] == [(1, 0, 0.0), (2, 1, 0.0), (3, 1, 2.5)]


def test_propagation_sends_clusters_not_assignments(spark):
    points = spark.range(300).selectExpr("id as row_id", "array(double(id % 7), 1.0D) as vec")
    spread = clustering.LabelPropagator({"a": points}, "row_id", clustering.SeededCentroids(3, 1))
    out = spread.propagate(spark.createDataFrame([(0, "a", True)], "row_id long, column string, is_error boolean"))
    join = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in x][0]
    assert "BuildRight" in join and out.count() == 300
