"""The workflow engine: paths, templates, routing, functions, documents, rounds, jobs, and queries against DuckDB."""

import json
import os
import subprocess
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from threading import Thread

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import queries, workflow_queries
from weftline.functions import paths, text
from weftline.functions.backends import CallableBackend
from weftline.jobs import policies
from weftline.operators import grid, http, lambdas, model, reshape, retrieval, rows
from weftline.operators.router import Router, RouteRule

from weftline.plans.dynamic import Library, parse_decision, posted_planner, run_rounds
from weftline.plans.graph import Engine, WorkflowError
from weftline.sources import tables
from weftline.spec.documents import expressions, from_n8n, from_native, from_yaml
from weftline.streaming import windows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("value", "path", "expected"),
    [
        ({"output": "so"}, "output", "so"),
        ({"metadata": {"prompt": "ask"}}, "metadata.prompt", "ask"),
        ({"table": '{"name":{"0":"Peru"}}'}, "table.name", {"0": "Peru"}),
        ({"index": 3, "status_code": 502, "error": "no answer"}, "json", None),
        ({"json": {"choices": [{"message": {"content": "x"}}]}}, "json.choices[0].message.content", "x"),
        ({"rows": [{"a": "r0"}, {"a": "r1"}]}, "rows.a", ["r0", "r1"]),
        ({"a": 1}, "", {"a": 1}),
    ],
)
def test_walk(value, path, expected):
    assert paths.walk(value, path) == expected


@pytest.mark.parametrize(("value", "path"), [({"output": "x"}, "metadata"), ({"output": 42}, "output.nested"), ({}, "choices[abc]"), ({}, "a..b"), ({"a": "no json"}, "a.b"), ({"a": []}, "a[0]")])
def test_walk_errors(value, path):
    with pytest.raises(paths.PathError):
        paths.walk(value, path)


def test_as_text():
    assert [paths.as_text(x) for x in ("a", 42, True, None, 1.5, [1, 2, 3], {"a": 1})] == ["a", "42", "true", "null", "1.5", "[1, 2, 3]", '{"a": 1}']


def test_templates(spark):
    df = spark.createDataFrame([(1, "a", True, None, 2.5)], "i int, s string, b boolean, n string, x double")
    columns = text.frame_columns(df, df.columns)
    got = df.select(text.render("{i}|{s}|{b}|{n}|{{x}}|{x:.2f}|{s:>3s}", columns).alias("t")).first()["t"]
    assert got == "1|a|True|None|{x}|2.50|  a"
    with pytest.raises(ValueError, match="inputs are"):
        text.render("{other}", columns)


def test_router_literals(spark):
    data = [("a", "hello"), ("b", "DIAGNOSIS READY: flu"), ("c", "REQUEST TEST: cbc"), ("d", "REQUEST TEST")]
    df = spark.createDataFrame(data, "case_id string, text string").select(F.struct("case_id", "text").alias("value"))
    router = Router((RouteRule("diagnose", "contains", "DIAGNOSIS READY"), RouteRule("test", "contains", "REQUEST TEST")), "patient", "text")
    found = {b: [r["value"]["case_id"] for r in d.collect()] for b, d in router.branches(df).items()}
    assert found == {"patient": ["a"], "diagnose": ["b"], "test": ["c", "d"]}
    for rules, default in [((RouteRule("x y", "contains", "v"),), "d"), ((RouteRule("d", "contains", "v"),), "d"), ((RouteRule("a", "is", "v"),), "d"), ((), "d")]:
        with pytest.raises(ValueError):
            Router(rules, default)


def test_lambda_contract():
    lambdas.validate("lambda row: sorted(row)[0]")
    lambdas.validate("def f(rows):\n    import math\n    return [math.sqrt(x) for x in rows]", "f")
    for code, name in [("lambda a, b: a", None), ("lambda r: open(r)", None), ("async def f(x): return x", "f"), ("def f(x):\n    from . import y\n    return y", "f"), ("1 +", None), ("x = 1", "f")]:
        with pytest.raises(lambdas.LambdaError):
            lambdas.validate(code, name)


def test_alignment(spark):
    many, one = rows.literal(spark, ["a", "b"]), rows.literal(spark, ["x"])
    got = rows.align({"m": many, "o": one}, {"m": 2, "o": 1}).orderBy("row_id").collect()
    assert [(r["m"], r["o"]) for r in got] == [("a", "x"), ("b", "x")]
    with pytest.raises(ValueError, match="differ in length"):
        rows.align({"m": many, "o": one}, {"m": 2, "o": 3})


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=2), max_size=3), min_size=1, max_size=5))
def test_regroup_undoes_flatten(spark, groups):
    df = spark.createDataFrame(list(enumerate(groups)), "row_id long, value array<string>")
    again = reshape.regroup(df, reshape.flatten(df, "value"))
    assert {r["row_id"]: r["value"] for r in again.collect()} == dict(enumerate(groups))


def test_reading_queries_only(spark):
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x VALUES (1)", "SELECT * FROM x FOR UPDATE"):
        with pytest.raises(ValueError):
            retrieval.read_only(spark, bad)
    assert retrieval.limited(spark, "SELECT * FROM range(10);", 3).count() == 3
    assert retrieval.relations(spark, "WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN b ON true") == ["a", "b"]


def test_values_are_not_spliced(spark):
    params = spark.createDataFrame([(0, "x' OR '1'='1"), (1, "b")], "row_id long, p string")
    spark.createDataFrame([("a",), ("b",)], "v string").createOrReplaceTempView("vs")
    found = retrieval.as_tables(params, retrieval.per_row(params, "SELECT v FROM vs WHERE v = '{p}'"))
    assert {r["row_id"]: [x["v"] for x in r["table"]] for r in found.collect()} == {0: [], 1: ["b"]}


def test_http(spark):
    with pytest.raises(ValueError):
        http.HttpRequest("http://a")
    calls = http.fetch(rows.literal(spark, ["1", "2"]), http.HttpRequest("u/{query}", retries=0), lambda m, url, body: (200, url) if url.endswith("1") else (500, ""))
    assert {r["row_id"]: (r["status_code"], r["body"]) for r in calls.collect()} == {0: (200, "u/1"), 1: (500, None)}


def test_model_steps(spark):
    df = rows.literal(spark, ["a", "b"])
    upper = CallableBackend(lambda: lambda prompts: [p.upper() for p in prompts])
    assert {r["output"] for r in model.completion(df, F.col("value"), upper).collect()} == {"A", "B"}
    with pytest.raises(Exception, match="blank"):
        model.embed(rows.literal(spark, [" "]), "value").collect()
    with pytest.raises(Exception, match="no integer seed"):
        df.select(model.row_seed(F.col("value"))).collect()


YAML = """
name: hello
inputs: {Name: [Ada, Bo]}
ops:
  - {id: Greet, op: FormatOp, template: "Hello {n}", format_kwargs: {n: Name}}
  - {id: Answer, op: LLMChatOp, prompt: {template: "{g}!", format_kwargs: {g: Greet}}, messages: [{role: system, content: Be kind.}]}
  - {id: Again, op: FormatOp, template: "Hello {n}", format_kwargs: {n: Name}}
  - {id: Shout, op: LambdaOp, inputs: [Again], code: "lambda row: row[0].upper()"}
outputs: [{name: answer, ref: Answer}, {name: shout, ref: Shout}]
"""


def test_yaml_workflow(spark):
    flow = from_yaml(YAML)
    assert len(flow.deduplicated().steps) == len(flow.steps) - 1 and flow.unread() == []
    out = Engine(spark).run(flow)
    assert [r["value"] for r in out["shout"].orderBy("row_id").collect()] == ["HELLO ADA", "HELLO BO"]
    import hashlib

    assert [r["value"] for r in out["answer"].orderBy("row_id").collect()] == [hashlib.md5(f"system: Be kind.\nuser: Hello {n}!".encode()).hexdigest() for n in ("Ada", "Bo")]
    assert "Statistics" in Engine(spark).preview(flow)["answer"]
    again = from_native(json.loads(json.dumps(flow.to_native())))
    assert {i: s.settings for i, s in again.steps.items()} == {i: s.settings for i, s in flow.steps.items()} and again.outputs == flow.outputs
    assert again.template_hash() == from_native(flow.to_native()).template_hash()


@pytest.mark.parametrize(
    "text_",
    [
        "ops: []", "ops: [{id: a, op: Nope}]", "ops: [{id: a, op: FormatOp, template: x, extra: 1}]", "ops: [{id: a, op: FormatOp, template: '{b}', format_kwargs: {b: b}}]",
        "ops: [{id: a, op: DataOp, data: [x]}, {id: a, op: DataOp, data: [y]}]", "inputs: {a: [1]}\nops: [{id: b, op: DataOp, data: [x]}]",
        "ops: [{id: a, op: FormatOp, template: '{b}', format_kwargs: {b: b}}, {id: b, op: FormatOp, template: '{a}', format_kwargs: {a: a}}]",
    ],
)
def test_yaml_errors(text_):
    with pytest.raises(WorkflowError):
        from_yaml(text_)


def test_n8n_is_equal_to_yaml(spark):
    n8n = {
        "name": "q", "connections": {"Trigger": {"main": [[{"node": "Rows"}]]}},
        "nodes": [
            {"name": "Trigger", "type": "x.chatTrigger"},
            {"name": "Rows", "type": "x.postgres", "parameters": {"operation": "executeQuery", "query": "SELECT r_regionkey FROM region WHERE r_name = {{ $('Trigger').item.json.output }}"}},
            {"name": "Chat", "type": "x.chainLlm", "parameters": {"text": "Say {{ $('Trigger').item }} {x}"}},
        ],
    }
    flow = from_n8n(json.dumps(n8n))
    twin = from_yaml("""
ops:
  - {id: Trigger, op: InputOp}
  - {id: Rows, op: DataRetrievalOp, data_spec: {mode: sql, template: "SELECT r_regionkey FROM region WHERE r_name = {output}", params: [{label: output, node: Trigger, path: output}]}}
  - {id: Chat, op: LLMChatOp, prompt: {template: "Say {trigger} {{x}}", format_kwargs: {trigger: Trigger}}}
outputs: [{name: Chat, ref: Chat}]
""")
    tables.register(spark, DATA, ["region"])
    one = Engine(spark).build(flow, Trigger=["ASIA"])["Chat"].df.collect()
    assert one == Engine(spark).build(twin, Trigger=["ASIA"])["Chat"].df.collect()
    assert expressions("{{ $('A').item.x }} {{ $('B').item.x }}") == ("{x} {x_2}", [{"label": "x", "node": "A", "path": "x"}, {"label": "x_2", "node": "B", "path": "x"}])


def test_rounds(spark):
    answers = ['<think>hm</think>```json\n{"next":"subgraph","ops":[{"id":"a","op":"FormatOp","template":"{n}!","format_kwargs":{"n":"Name"}}]}\n```', '{"next":"subgraph","ops":[{"id":"b","op":"FormatOp","template":"{a}?","format_kwargs":{"a":"a"}}],"export":["b"]}', '{"next":"STOP"}']
    out = run_rounds(Engine(spark), {"Name": ["x", "y"]}, lambda seen, k: answers[k])
    assert [r["output"] for r in out["b"].orderBy("row_id").collect()] == ["x!?", "y!?"]
    for bad in ("{}", '{"next":"subgraph","ops":[]}', '{"next":"subgraph","ops":[1],"more":1}', "nope"):
        with pytest.raises(WorkflowError):
            parse_decision(bad)
    library = Library({"q": {"op": "DataRetrievalOp", "param_bindings": ["p"], "data_spec": {"template": "SELECT {p}", "params": [{"label": "p"}]}}})
    assert library.expand({"ref": "q", "id": "z", "inputs": ["Name"]})["data_spec"]["params"] == [{"label": "p", "node": "Name"}]


def plain_batch(distance, enqueued, k):
    """Average linkage over all pairs, recomputed at every step."""
    n = len(distance)

    def mean(pairs):
        pairs = list(pairs)
        return round(sum(distance[a][b] for a, b in pairs) / len(pairs), 9) if pairs else 0.0

    def subset(members):
        offers = []
        for seed in members:
            taken = [seed]
            while len(taken) < k:
                rest = [m for m in members if m not in taken]
                taken.append(min(rest, key=lambda m: (mean((m, t) for t in taken), enqueued[m], m)))
            offers.append((mean((a, b) for i, a in enumerate(taken) for b in taken[i + 1:]), min(enqueued[m] for m in taken), taken))
        return min(offers, key=lambda o: o[:2])

    clusters, best = [[i] for i in range(n)], None
    while len(clusters) > 1:
        i, j = min(((i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))), key=lambda x: mean((a, b) for a in clusters[x[0]] for b in clusters[x[1]]))
        both = clusters[i] + clusters[j]
        clusters = [c for x, c in enumerate(clusters) if x not in (i, j)] + [both]
        if len(both) >= k and (best is None or subset(both)[:2] < best[:2]):
            best = subset(both)
    return best[2]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(4, 9), st.integers(2, 4))
def test_affinity_batch(seed, n, k):
    import numpy as np

    rnd = np.random.default_rng(seed)
    d = rnd.integers(1, 1000, (n, n)) / 1000
    d = np.triu(d, 1) + np.triu(d, 1).T
    assert sorted(policies.linked_batch(d, list(range(n)), k)) == sorted(plain_batch(d.tolist(), list(range(n)), k))


def test_affinity_batch_takes_an_item_of_each_user(spark):
    queue = spark.createDataFrame([(i, ["m"] if i < 6 else [f"m{i}"], ["w"], 1.0, i % 3, i) for i in range(12)], "item_id long, models array<string>, words array<string>, size double, user_id int, at long")
    out = policies.affinity_batch(queue.withColumn("enqueued_at", F.timestamp_seconds("at")), 4).orderBy("place").collect()
    assert {r["item_id"] % 3 for r in out[:3]} == {0, 1, 2} and all(r["item_id"] < 6 for r in out)
    assert policies.affinity_batch(queue.where("false").withColumn("enqueued_at", F.timestamp_seconds("at")), 4).count() == 0


class Stub(BaseHTTPRequestHandler):
    calls: list = []

    def do_GET(self):
        self.send_response(404 if self.path.endswith("none") else 200)
        self.end_headers()
        if not self.path.endswith("none"):
            self.wfile.write(json.dumps({"path": self.path}).encode())

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Stub.calls.append((self.headers.get("Authorization"), body))
        if len(Stub.calls) == 1:  # the first request fails
            self.send_response(503)
            self.end_headers()
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]}).encode())

    def log_message(self, *args):
        pass


def test_services_over_the_network(spark):
    secret = os.environ["HOME"]  # a variable that Python workers have too
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        flow = from_yaml(f"inputs: {{n: [x]}}\nops: [{{id: h, op: HttpFetchOp, url: '{url}/{{query}}', query: n}}, {{id: c, op: LLMChatOp, prompt: {{template: 'ask {{n}}', format_kwargs: {{n: n}}}}, config: {{model: m, temperature: 0.1, api: {{url: '{url}', authorization: HOME, concurrency: 1}}}}}}]\noutputs: [{{name: h, ref: h, path: json.path}}, {{name: c, ref: c}}]")
        engine = Engine(spark, fetcher=http.over_network)
        out = engine.run(flow, n=["a", "none"])
        assert {r["row_id"]: r["value"] for r in out["h"].collect()} == {0: "/a", 1: "null"}
        assert secret not in out["c"]._jdf.queryExecution().toString()
        assert {r["row_id"]: r["value"] for r in out["c"].collect()} == {0: "ASK A", 1: "ASK NONE"}
        assert all(key == secret and body["temperature"] == 0.1 and body["model"] == "m" for key, body in Stub.calls)
    finally:
        server.shutdown()


def test_a_false_condition_asks_nothing(spark, tmp_path):
    def make():
        def answer(prompts):
            (tmp_path / "asked").touch()
            return prompts

        return answer

    flow = from_yaml("inputs: {n: [x], go: ['no']}\nops: [{id: a, op: LLMChatOp, prompt: {template: '{n}', format_kwargs: {n: n}}, condition: {node: go}}]\noutputs: [{name: a, ref: a}]")
    assert Engine(spark, backend=CallableBackend(make)).run(flow, n=["a", "b"])["a"].count() == 0
    assert not (tmp_path / "asked").exists()


def test_n8n_nodes_that_cannot_be_read():
    doc = {"nodes": [{"name": "X", "type": "n8n-nodes-base.slack", "parameters": {}}], "connections": {}}
    with pytest.raises(WorkflowError, match="slack"):
        from_n8n(json.dumps(doc))


def test_vectors_that_are_missing(spark):
    got = spark.createDataFrame([(0, [[1.0], [2.0]])], "row_id long, embeddings array<array<float>>")
    with pytest.raises(Exception, match="2 vectors, not 3"):
        model.fanned_out(got, got.select("row_id", F.lit(3).alias("n"))).collect()


def test_planned_queries_wait_and_ask_again():
    waits, answers = [], iter([OSError("down"), {"choices": []}, {"choices": [{"message": {"content": "STOP"}}]}])

    def post(body):
        found = next(answers)
        if isinstance(found, OSError):
            raise found
        return found

    assert posted_planner(post, "m", "goal", wait=waits.append)("seen", 0) == "STOP" and waits == [1.0, 2.0]


def test_streams_agree_with_batches(spark, tmp_path):
    events = tables.table(spark, DATA, "events")
    events.write.parquet(str(tmp_path / "in"))
    live = windows.tumbling(windows.stream(spark, str(tmp_path / "in"), events), "1 hour").writeStream.outputMode("complete").format("memory").queryName("live").start()
    live.processAllAvailable()
    live.stop()
    assert spark.table("live").count() == windows.tumbling(events, "1 hour").count()


def test_sources_and_sinks(spark, tmp_path):
    df = rows.literal(spark, ["b", "a"])
    tables.write_values(df, str(tmp_path / "items") + "/")
    assert [p.name for p in sorted(Path(tmp_path / "items").glob("*.txt"))] == ["item-000001.txt", "item-000002.txt"]
    for kind in ("parquet", "orc", "json"):
        tables.write(df, str(tmp_path / kind), kind)
    assert tables.read(spark, str(tmp_path / "json"), "jsonl", "row_id long, value string").count() == 2
    assert retrieval.expand_prefix(spark, str(tmp_path / "items")).count() >= 2
    store = retrieval.objects(spark, str(tmp_path / "items"), "*.txt")
    assert retrieval.object_contents(store.select(F.lit(0).cast("long").alias("row_id"), F.col("path").alias("value")).limit(1), store).first()["content"]


@pytest.mark.parametrize("name", sorted(workflow_queries.ORACLES))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables.NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found, twin = queries.QUERIES[name](spark, DATA), con.execute(queries.ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(found.columns) == sorted(names)

    def plain(row):
        return tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row)

    assert sorted(plain(r) for r in found.select(*[F.col(f"`{n}`") for n in names]).collect()) == sorted(map(plain, twin.fetchall()))


@pytest.mark.parametrize("name", ["http_fetch", "object_contents"])
def test_pages_that_share_urls(spark, tmp_path, name):
    page = [(0, "u", "a"), (1, "u", "b"), (2, "u", "b"), (3, "v", "c"), (4, "u/none", None), (5, "u", "d"), (6, None, "e"), (7, None, "f"), (8, "v", "")]
    spark.createDataFrame(page, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    twin = con.execute(queries.ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(map(str, (tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(names).collect()))) == sorted(map(str, twin.fetchall()))


@pytest.mark.parametrize("many", [False, True])
def test_nearest_vectors(spark, tmp_path, monkeypatch, many):
    """Copies, scaled copies, zeros, null vectors and one common vector, in one cell and in many; as DuckDB ranks them."""
    if many:
        monkeypatch.setattr(grid, "MOST", 500)
    rng = np.random.default_rng(3)
    some = rng.normal(size=(40, 5)).round(2)
    vectors = [some[rng.integers(40)].tolist() for _ in range(150)] + [(2 * some[i]).tolist() for i in range(40)] + [some[0].tolist()] * 30 + [[0.0] * 5, None]
    spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = queries.QUERIES["embedding_topk_cosine"](spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in found.select("qid", "vec_id", "score").collect()))) == sorted(map(str, con.execute(queries.ORACLES["embedding_topk_cosine"]).fetchall()))


def test_affinity_to_all(spark, monkeypatch):
    """The same distances as of single pairs, in many cells; empty, null and repeated values."""
    monkeypatch.setattr(policies, "AFFINITY_PAIRS", 40)
    items = [(i, [["m"], ["m", "n"], [], [None]][i % 4], [["x"], ["y", "x"], ["y", "z", "y"], [], None][i % 5], [None, 0.0, 3.0, 5.0][i % 4 if i % 7 else 0]) for i in range(60)]
    queue = spark.createDataFrame(items, "item_id long, models array<string>, words array<string>, size double")
    pairs = queue.where("item_id % 10 = 0").select(F.col("item_id").alias("a")).crossJoin(queue.select(F.col("item_id").alias("b"))).where("a <> b")
    plain, found = ({(r["a"], r["b"]): r["distance"] for r in df.collect()} for df in (policies.affinity(queue, pairs), policies.affinity_to_all(queue, "item_id % 10 = 0")))
    assert len(found) == 6 * 59 and found == plain


def test_entry_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for p in ("__spark_entry__.py", "weftline"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
    import shutil

    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'digest_workflow' in q and not any(k.startswith('op') and k[2].isdigit() for k in q), list(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})


def test_affinity_to_all_shuffles_few_copies(spark, monkeypatch):
    """The number of pairs that are held at once does not raise the number of copies that are shuffled."""
    from weftline.operators import grid

    made, dealt = [], grid._dealt
    monkeypatch.setattr(grid, "_dealt", lambda *a: made.append(dealt(*a)) or made[-1])
    queue = spark.range(600).selectExpr("id AS item_id", "array(concat('m', id % 3)) AS models", "array('w', concat('x', id % 7)) AS words", "double(id % 11) AS size")
    found = []
    for most in (1 << 20, 9):
        monkeypatch.setattr(policies, "AFFINITY_PAIRS", most)
        found.append(sorted(tuple(r) for r in policies.affinity_to_all(queue, "item_id % 50 = 0").collect()))
    assert len(found[0]) == 12 * 599 and found[0] == found[1]
    assert [df.count() for df in made] == [612, 612]
    monkeypatch.setattr(grid, "HELD", 5)  # queries in more than one part
    monkeypatch.setattr(grid, "WORTH", 500)
    assert sorted(tuple(r) for r in policies.affinity_to_all(queue, "item_id % 50 = 0").collect()) == found[0]
