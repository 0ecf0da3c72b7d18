"""Queries over whole workflows, documents, rounds, services, sinks and profiles, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from weftline.functions.backends import DIGEST, ApiBackend
from weftline.functions.generation import Generation
from weftline.functions.paths import walk
from weftline.jobs import policies
from weftline.operators import http, model, retrieval, rows
from weftline.operators.model import Field
from weftline.operators.router import Router, RouteRule
from weftline.plans import profile
from weftline.plans.dynamic import Library, RoundTemplate, posted_planner, run_rounds, run_template
from weftline.plans.graph import Engine, Frame, Output, Step, Workflow, WorkflowError, data, merged
from weftline.plans.shared import cut
from weftline.queries import DIGEST_WORKFLOW, ORACLES, query
from weftline.sources import tables
from weftline.sources.tables import register, table
from weftline.spec.documents import from_n8n, from_native, from_yaml

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_REGIONS = "(VALUES (0, 'AFRICA'), (1, 'AMERICA'), (2, 'ASIA'), (3, 'EUROPE'), (4, 'MIDDLE EAST')) r(i, name)"


# Retrieval


@query("""SELECT i::BIGINT AS row_id, count(n_name)::BIGINT AS n, min(n_name) AS first FROM (VALUES (0, 'an'), (1, 'IA'), (2, 'zz')) q(i, q) LEFT JOIN nation ON n_name LIKE '%' || q || '%' GROUP BY i""")
def retrieval_like(spark, sf_dir):
    """A placeholder inside a longer literal."""
    register(spark, sf_dir, ["nation"])
    params = rows.literal(spark, ["an", "IA", "zz"]).withColumnRenamed("value", "q")
    found = retrieval.per_row(params, "SELECT count(n_name) AS n, min(n_name) AS first FROM nation WHERE n_name LIKE '%{q}%'")
    return found.select("row_id", "n", "first")


@query("""SELECT n_nationkey::BIGINT AS row_id, 'say "hi" 5::text {x}' || n_name || '''s -- no' AS line, 'a;b' AS two FROM nation""")
def retrieval_literals(spark, sf_dir):
    """Literals with quotes, casts, doubled quotes and comment marks stay as they are."""
    register(spark, sf_dir, ["nation"])
    params = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.col("n_nationkey").alias("k"), F.lit("{x}").alias("x"))
    template = """SELECT 'say "hi" 5::text {x}' || "n_name"::text || '''s -- no' AS line, 'a;b' AS two FROM nation /* {k} is bound below */ WHERE n_nationkey = {k} -- last {k}"""
    return retrieval.per_row(params, template).select("row_id", "line", "two")


@query("""SELECT row_id, pos::BIGINT AS pos, o_orderkey FROM (SELECT c_custkey AS row_id, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS pos FROM customer JOIN orders ON o_custkey = c_custkey) WHERE pos < 4""")
def retrieval_bounded(spark, sf_dir):
    """At most four rows for each parameter row."""
    register(spark, sf_dir, ["orders"])
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("c"))
    return retrieval.per_row(customers, "SELECT o_orderkey FROM orders WHERE o_custkey = {c} ORDER BY o_orderkey", most=4).select("row_id", "pos", "o_orderkey")


@query("SELECT o_orderpriority, sum(o_totalprice) AS sum_o_totalprice, max(o_orderkey) AS max_o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def agent_aggregate(spark, sf_dir):
    register(spark, sf_dir, ["orders", "part"])
    found = retrieval.planned(spark, "total o_totalprice and highest o_orderkey of orders by o_orderpriority where o_orderstatus is 'F'", retrieval.keyword_planner, ["orders", "part"])
    return found.withColumn("sum_o_totalprice", F.col("sum_o_totalprice").cast("double"))


@query("SELECT 0::BIGINT AS row_id, '[{\"n\":' || count(*) || '}]' AS value FROM orders WHERE o_orderstatus = 'P'")
def agent_workflow(spark, sf_dir):
    """A planned query whose description has a parameter."""
    register(spark, sf_dir, ["orders"])
    flow = from_yaml("""
inputs: {status: [P]}
ops:
  - id: found
    op: DataRetrievalOp
    data_spec: {mode: agent, description: "How many orders where o_orderstatus is '{status}'", schema_scope: [orders], params: [{label: status, node: status}]}
outputs: [{name: found, ref: found, path: items.table}]
""")
    return Engine(spark).run(flow)["found"]


@query("""SELECT page_id AS row_id, CASE WHEN page_id % 3 <> 0 THEN html END AS content FROM pages""")
def object_contents(spark, sf_dir):
    """Objects by key; a missing object is null."""
    # pages share urls, so an object is stored at its page's url and id
    pages = table(spark, sf_dir, "pages").withColumn("path", F.concat_ws("#", "url", "page_id"))
    store = pages.where("page_id % 3 <> 0").select("path", F.encode("html", "UTF-8").alias("content"))
    return retrieval.object_contents(pages.select(F.col("page_id").alias("row_id"), F.col("path").alias("value")), store)


@query("""SELECT r.i::BIGINT AS row_id, md5(html) AS value FROM (SELECT page_id - 1 AS i, url FROM pages WHERE page_id BETWEEN 1 AND 3) r JOIN pages USING (url)""")
def object_workflow(spark, sf_dir):
    """Object retrieval whose key comes from an input."""
    pages = table(spark, sf_dir, "pages")
    first = [r["url"] for r in pages.where("page_id BETWEEN 1 AND 3").orderBy("page_id").select("url").collect()]
    flow = from_yaml("""
inputs: {key: [x]}
ops:
  - {id: page, op: DataRetrievalOp, data_spec: {mode: s3, template: "{key}", params: [{label: key, node: key}]}}
outputs: [{name: page, ref: page, path: items.content}]
""")
    out = Engine(spark, objects=pages.select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))).run(flow, key=first)["page"]
    return out.select("row_id", F.md5(F.col("value").cast("binary")).alias("value"))


@query("SELECT 0::BIGINT AS row_id, 'region.parquet' AS name")
def object_prefix(spark, sf_dir):
    found = retrieval.expand_prefix(spark, f"{sf_dir}/region.parquet")
    return found.select("row_id", F.element_at(F.split("value", "/"), -1).alias("name"))


@query("SELECT (json_extract_string(props, '$.k'))::BIGINT AS k, count(*)::BIGINT AS n FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY 1")
def sampled_lines(spark, sf_dir):
    """JSON lines without blank lines, bad lines and lines that hold no object."""
    events = table(spark, sf_dir, "events")
    lines = events.select(F.when(F.col("event_id") % 5 == 0, "{bad").when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, " ").otherwise("[1]")).otherwise(F.col("props")).alias("value"))
    return tables.sample_rows(spark, lines, "k string", most=1_000_000_000).groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('orders', 'o_orderkey', true), ('orders', 'c_custkey', false), ('nowhere', 'x', false)) t(\"table\", \"column\", \"there\")")
def column_checks(spark, sf_dir):
    register(spark, sf_dir, ["orders"])
    asked = [("orders", "o_orderkey"), ("orders", "c_custkey"), ("nowhere", "x")]
    return spark.createDataFrame([(t, c, retrieval.column_exists(spark, t, c)) for t, c in asked], "table string, column string, there boolean")


@query("SELECT * FROM (VALUES ('customer'), ('orders'), ('region')) t(name)")
def query_relations(spark, sf_dir):
    found = retrieval.relations(spark, 'WITH big AS (SELECT * FROM "orders" WHERE note <> \'from part\') SELECT * FROM big JOIN customer ON true, region')
    return spark.createDataFrame([(n,) for n in found], "name string")


@query("""WITH s AS (SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, length(html) AS length FROM pages) SELECT round(avg(m), 6) AS mean_bytes FROM (SELECT avg(length) AS m FROM s GROUP BY folder)""")
def folder_means(spark, sf_dir):
    store = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.char_length("html").cast("long").alias("length"))
    return retrieval.mean_of_folder_means(store).withColumn("mean_bytes", F.round("mean_bytes", 6))


_CUBE = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS INT) AS g, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY "


@query(_CUBE + "CUBE (l_returnflag, l_linestatus)")
def sql_passthrough_cube(spark, sf_dir):
    register(spark, sf_dir, ["lineitem"])
    return spark.sql(retrieval.read_only(spark, _CUBE + "CUBE (l_returnflag, l_linestatus)"))


@query(_CUBE + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def sql_passthrough_grouping_sets(spark, sf_dir):
    register(spark, sf_dir, ["lineitem"])
    return spark.sql(retrieval.read_only(spark, _CUBE + "GROUPING SETS ((l_returnflag), (l_linestatus), ())"))


_EXISTS = "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AS big FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"


@query(_EXISTS)
def sql_passthrough_exists(spark, sf_dir):
    register(spark, sf_dir, ["customer", "orders"])
    return spark.sql(retrieval.read_only(spark, _EXISTS))


_BETWEEN = "SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity BETWEEN p_size - 2 AND p_size + 2 GROUP BY p_partkey"


@query(_BETWEEN)
def sql_passthrough_range_join(spark, sf_dir):
    register(spark, sf_dir, ["part", "lineitem"])
    return spark.sql(retrieval.read_only(spark, _BETWEEN))


@query("SELECT event_id, user_id, before FROM (SELECT e.event_id, e.user_id, lag(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events e)")
def asof_previous(spark, sf_dir):
    """As-of: the last view of the user before each event."""
    register(spark, sf_dir, ["events"])
    return spark.sql(retrieval.read_only(spark, "SELECT event_id, user_id, lag(CASE WHEN event_type = 'view' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"))


# Documents


ORACLES["native_round_trip"] = ORACLES["digest_workflow"]


@query(ORACLES["digest_workflow"])
def native_round_trip(spark, sf_dir):
    """The digest workflow written as native JSON and read back."""
    register(spark, sf_dir, ["orders", "customer"])
    flow = from_yaml(DIGEST_WORKFLOW)
    twin = from_native(json.loads(json.dumps(flow.to_native())))
    return Engine(spark).run(twin, **{k: list(v) for k, v in flow.inputs.items()})["digest"]


N8N = json.dumps({
    "name": "chat",
    "nodes": [
        {"name": "Region", "type": "@n8n/n8n-nodes-langchain.chatTrigger", "parameters": {}},
        {"name": "Rows", "type": "n8n-nodes-base.postgres", "parameters": {"operation": "executeQuery", "query": "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{{ $('Region').item.json }}' ORDER BY n_name"}},
        {"name": "Each", "type": "@n8n/n8n-nodes-langchain.chainLlm", "parameters": {"text": "Nations of {{ $('Region').item.json }}:\n```table\nname: {{ $('Rows').item.n_name }}\n```"}},
        {"name": "Model", "type": "@n8n/n8n-nodes-langchain.lmChatOpenAi", "parameters": {}},
        {"name": "Vector", "type": "@n8n/n8n-nodes-langchain.embeddingsOpenAi", "parameters": {}},
        {"name": "Note", "type": "n8n-nodes-base.stickyNote", "parameters": {}},
    ],
    "connections": {"Model": {"ai_languageModel": [[{"node": "Each"}]]}, "Region": {"main": [[{"node": "Rows"}, {"node": "Vector"}]]}},
})


@query(f"""SELECT i::BIGINT AS row_id, md5('user: Nations of ' || name || ':' || chr(10) || 'name' || chr(10) || string_agg(n_name, chr(10) ORDER BY n_name)) AS value, round(('0x' || substr(md5(name), 1, 2))::INT / 255.0, 5) AS first
FROM {_REGIONS} JOIN region ON r_name = name JOIN nation ON n_regionkey = r_regionkey GROUP BY i, name""")
def n8n_workflow(spark, sf_dir):
    """An n8n document: trigger, query with an expression, chain with a table block, embedding; a note is left out."""
    register(spark, sf_dir, ["nation", "region"])
    built = Engine(spark).build(from_n8n(N8N), Region=REGIONS)
    vectors = built["Vector"].df.select("row_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))
    return built["Each"].df.select("row_id", F.col("output").alias("value")).join(vectors, "row_id")


@query(f"""SELECT i::BIGINT AS row_id, md5('system: Short.' || chr(10) || 'user: ' || name || chr(10) || 'assistant: Yes.' || chr(10) || 'user: About ' || name || '!') AS value FROM {_REGIONS}""")
def yaml_messages(spark, sf_dir):
    """Turns that are texts, a step's bare id, and the prompt's place; steps stand out of order."""
    flow = from_yaml("""
inputs: {name: [x]}
ops:
  - id: said
    op: LLMChatOp
    messages: [{role: system, content: Short.}, {role: user, content: name}, {role: assistant, content: Yes.}, {role: user, content: about}]
  - {id: about, op: FormatOp, template: "About {0}!", format_args: [name]}
outputs: [{name: said, ref: said}]
""")
    return Engine(spark).run(flow, name=REGIONS)["said"]


def _refused(make) -> bool:
    try:
        make()
    except (ValueError, TypeError, KeyError):
        return True
    return False


_DOCUMENTS = {
    "cycle": "ops: [{id: a, op: FormatOp, template: '{0}', format_args: [b]}, {id: b, op: FormatOp, template: '{0}', format_args: [a]}]",
    "duplicate id": "ops: [{id: a, op: DataOp, data: [x]}, {id: a, op: DataOp, data: [y]}]",
    "duplicate output": "ops: [{id: a, op: DataOp, data: [x]}]\noutputs: [{name: o, ref: a}, {name: o, ref: a}]",
    "fine": "ops: [{id: a, op: DataOp, data: [x]}]\noutputs: [{name: o, ref: a}]",
    "forward reference": "ops: [{id: b, op: FormatOp, template: '{0}', format_args: [a]}, {id: a, op: DataOp, data: [x]}]",
    "input no list": "inputs: {q: x}\nops: [{id: a, op: DataOp, data: [x]}]",
    "no ops": "name: x",
    "unknown op": "ops: [{id: a, op: NoOp}]",
    "unknown setting": "ops: [{id: a, op: DataOp, data: [x], more: 1}]",
    "unknown step": "ops: [{id: a, op: FormatOp, template: '{0}', format_args: [z]}]",
}


@query("SELECT name, name NOT IN ('fine', 'forward reference') AS refused FROM (VALUES " + ", ".join(f"('{n}')" for n in _DOCUMENTS) + ") t(name)")
def document_checks(spark, sf_dir):
    return spark.createDataFrame([(n, _refused(lambda t=t: from_yaml(t))) for n, t in _DOCUMENTS.items()], "name string, refused boolean")


_SETTINGS = {
    "both extras": {"temperature": 1, "extra_sampling_params": {"temperature": 0}}, "engine with service": {"model": "m", "api": {"url": "u"}, "dtype": "half"}, "fine": {"model": "m", "temperature": 0.5, "top_k": 3},
    "no model": {"api": {"url": "u"}}, "service": {"model": "m", "api": {"url": "u", "concurrency": 8}}, "too many at once": {"model": "m", "api": {"concurrency": 9}}, "two rules": {"output_enforcement": {"json_schema": {}, "text_regex": "x"}}, "unknown": {"heat": 1},
}


@query("SELECT name, name NOT IN ('fine', 'service') AS refused FROM (VALUES " + ", ".join(f"('{n}')" for n in _SETTINGS) + ") t(name)")
def generation_checks(spark, sf_dir):
    return spark.createDataFrame([(n, _refused(lambda c=c: Generation.of(c))) for n, c in _SETTINGS.items()], "name string, refused boolean")


_ROUTERS = {"bad name": ("a b", "contains", "x", "rest"), "empty value": ("a", "contains", "", "rest"), "fine": ("a", "contains", "x", "rest"), "is default": ("rest", "equals", "x", "rest")}


@query("SELECT name, name <> 'fine' AS refused FROM (VALUES " + ", ".join(f"('{n}')" for n in _ROUTERS) + ") t(name)")
def router_checks(spark, sf_dir):
    return spark.createDataFrame([(n, _refused(lambda r=r: Router((RouteRule(*r[:3]),), r[3]))) for n, r in _ROUTERS.items()], "name string, refused boolean")


_WALKS = [({"a": {"b": [1, 2]}}, "a.b[1]", "2"), ({"rows": [{"a": "x"}, {"a": "y"}]}, "rows.a", '["x", "y"]'), ({"t": '{"k": 3}'}, "t.k", "3"), ({"error": "boom"}, "out", "null"), ({"a": 1}, "b", "refused"), ({"a": 1}, "a.b", "refused"), ({}, "a..b", "refused")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w[2]}')" for i, w in enumerate(_WALKS)) + ") t(place, value)")
def strict_paths(spark, sf_dir):
    def found(value, path):
        try:
            return json.dumps(walk(value, path))
        except ValueError:
            return "refused"

    return spark.createDataFrame([(i, found(v, p)) for i, (v, p, _) in enumerate(_WALKS)], "place int, value string")


@query("SELECT * FROM (VALUES (0, 'a', 'DataOp'), (1, 'b', 'MessageOp'), (2, 'c', 'refused')) t(place, id, op)")
def data_helper(spark, sf_dir):
    made = []
    for i, (name, value) in enumerate([("a", "one"), ("b", [{"role": "user", "content": "x"}]), ("c", [1, 2])]):
        try:
            made.append((i, name, data(name, value).op))
        except WorkflowError:
            made.append((i, name, "refused"))
    return spark.createDataFrame(made, "place int, id string, op string")


_DIAMOND = """
inputs: {x: [q]}
ops:
  - {id: d, op: FormatOp, template: "{0}{1}", format_args: [b, c]}
  - {id: c, op: FormatOp, template: "{0}?", format_args: [x]}
  - {id: b, op: FormatOp, template: "{0}?", format_args: [x]}
  - {id: z, op: FormatOp, template: "{0}", format_args: [c]}
outputs: [{name: d, ref: d}]
"""


@query("SELECT * FROM (VALUES ('order', 'x b c d z'), ('merged', 'x b d z'), ('unread', 'z')) t(what, steps)")
def graph_order(spark, sf_dir):
    """Topological order, steps after equal ones are merged, and steps that no output needs."""
    flow = from_yaml(_DIAMOND)
    found = [("order", flow.order()), ("merged", flow.deduplicated().order()), ("unread", flow.unread())]
    return spark.createDataFrame([(w, " ".join(s)) for w, s in found], "what string, steps string")


@query(f"""SELECT i::BIGINT AS row_id, 'one' AS name, name || '?' || name || '?' AS value FROM {_REGIONS} UNION ALL SELECT i, 'two', md5(name) FROM {_REGIONS} UNION ALL SELECT 9, 'refused', 'true'""")
def graph_merge(spark, sf_dir):
    """Two workflows run as one; the same workflow twice is refused."""
    one, two = from_yaml(_DIAMOND), Workflow("two", {"y": Step("y", "InputOp"), "done": Step("done", "LLMCompletionOp", ("y",), {"prompt": "y"})}, (Output("done", "done"),), {"y": ("v",)})
    out = Engine(spark).run(merged(one, two), x=REGIONS, y=REGIONS)
    refused = spark.createDataFrame([(9, "refused", str(_refused(lambda: merged(one, one))).lower())], "row_id long, name string, value string")
    return out["d"].select("row_id", F.lit("one").alias("name"), "value").union(out["done"].select("row_id", F.lit("two").alias("name"), "value")).union(refused)


# Model steps


@query(f"SELECT i::BIGINT AS row_id, '{{\"output\":\"' || md5('user: ' || name) || '\"}}' AS value FROM {_REGIONS}")
def whole_items(spark, sf_dir):
    """A step's whole items as JSON."""
    flow = from_yaml("inputs: {n: [x]}\nops: [{id: c, op: LLMChatOp, prompt: {template: '{n}', format_kwargs: {n: n}}}]\noutputs: [{name: c, ref: c, path: items}]")
    return Engine(spark).run(flow, n=REGIONS)["c"]


@query(f"SELECT i::BIGINT AS row_id, md5('user: ' || name || chr(10) || '{{\"seed\":7,\"temperature\":0.5}}') AS value FROM {_REGIONS}")
def configured_chat(spark, sf_dir):
    """A step's settings go with its requests."""
    flow = from_yaml("inputs: {n: [x]}\nops: [{id: c, op: LLMChatOp, prompt: {template: '{n}', format_kwargs: {n: n}}, config: {model: m, temperature: 0.5, seed: 7}}]\noutputs: [{name: c, ref: c}]")
    return Engine(spark).run(flow, n=REGIONS)["c"]


def _echo(url, headers, body, timeout):
    text = "|".join([url, body["model"], str(body.get("temperature")), *(f"{m['role']}:{m['content']}" for m in body["messages"])])
    return {"choices": [{"message": {"content": hashlib.md5(text.encode()).hexdigest()}}]}


@query("SELECT doc_id, md5('stub|svc|0.5|system:Be brief.|user:' || coalesce(text, 'None')) AS output FROM documents")
def api_chat(spark, sf_dir):
    """All documents through a chat service's request bodies; the service's model goes before the step's."""
    config = Generation.of({"model": "own", "temperature": 0.5, "top_k": 5, "api": {"url": "stub", "model": "svc", "concurrency": 8}})
    turns = model.messages(("system", F.lit("Be brief.")), ("user", F.col("text")))
    return model.chat(table(spark, sf_dir, "documents").select("doc_id", "text"), turns, ApiBackend(config, _echo)).select("doc_id", "output")


@query(f"SELECT i::BIGINT AS row_id, md5('http://stub|m|None|user:Tell of ' || name) AS value FROM {_REGIONS}")
def api_workflow(spark, sf_dir):
    flow = from_yaml("inputs: {n: [x]}\nops: [{id: c, op: LLMChatOp, prompt: {template: 'Tell of {n}', format_kwargs: {n: n}}, config: {model: m, api: {url: 'http://stub'}}}]\noutputs: [{name: c, ref: c}]")
    return Engine(spark, post=_echo).run(flow, n=REGIONS)["c"]


@query(f"SELECT i::BIGINT AS row_id, name AS value, 'open' AS gate FROM (SELECT i, md5('user: ' || name) AS name FROM {_REGIONS})")
def condition_gate(spark, sf_dir):
    """Two gated steps: the true condition lets all rows through, the false one none."""
    text = "inputs: {n: [x], go: ['true'], shut: ['false']}\nops: [{id: a, op: LLMChatOp, prompt: {template: '{n}', format_kwargs: {n: n}}, condition: {node: go}}, {id: b, op: LLMChatOp, prompt: {template: '{n}', format_kwargs: {n: n}}, condition: {node: shut}}]\noutputs: [{name: a, ref: a}, {name: b, ref: b}]"
    out = Engine(spark).run(from_yaml(text), n=REGIONS)
    return out["a"].withColumn("gate", F.lit("open")).union(out["b"].withColumn("gate", F.lit("shut")))


@query(f"""SELECT i::BIGINT AS row_id, md5('user: Hello ' || name || chr(10) || 'assistant: ' || md5('user: Hello ' || name) || chr(10) || 'user: More') AS value FROM {_REGIONS}""")
def history_workflow(spark, sf_dir):
    flow = from_yaml("inputs: {n: [x]}\nops: [{id: a, op: LLMChatOp, prompt: {template: 'Hello {n}', format_kwargs: {n: n}}, return_history: true}, {id: b, op: LLMChatOp, messages: [{role: user, content: More}], history: a}]\noutputs: [{name: b, ref: b}]")
    return Engine(spark).run(flow, n=REGIONS)["b"]


@query(f"""WITH a AS (SELECT i, 'user: ' || name AS p FROM {_REGIONS}), b AS (SELECT i, md5(p) AS x, md5(p || chr(10) || '(attempt 2)') AS y FROM a)
SELECT i::BIGINT AS row_id, CASE WHEN regexp_matches(x, '^[0-9]') THEN x ELSE y END AS output, CASE WHEN regexp_matches(x, '^[0-9]') THEN 1 ELSE 2 END AS attempts, regexp_matches(x, '^[0-9]') OR regexp_matches(y, '^[0-9]') AS valid FROM b""")
def enforcement_workflow(spark, sf_dir):
    flow = from_yaml("inputs: {n: [x]}\nops: [{id: c, op: LLMChatOp, prompt: {template: '{n}', format_kwargs: {n: n}}, config: {output_enforcement: {text_regex: '^[0-9]', max_attempts: 2}}}]\noutputs: [{name: c, ref: c}]")
    return Engine(spark).build(flow, n=REGIONS)["c"].df.select("row_id", "output", "attempts", "valid")


@query("""SELECT event_id, coalesce((json_extract_string(props, '$.k'))::BIGINT BETWEEN 10 AND 60, false) AND event_id % 4 <> 0 AS valid FROM events""")
def schema_enforcement(spark, sf_dir):
    """JSON of a schema: required, bounded, and nothing besides."""
    schema = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}, "required": ["k"], "additionalProperties": False}
    text = F.when(F.col("event_id") % 4 == 0, F.regexp_replace("props", r"\}$", ', "more": 1}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", model.conforms(text, schema).alias("valid"))


@query("""SELECT vec_id AS row_id, (i - 1)::INT AS "row", embedding[i]::DOUBLE AS value FROM embeddings, range(1, 4) t(i)""")
def embedding_fan_out(spark, sf_dir):
    """An entry for each of a request's three vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform(F.slice("embedding", 1, 3), lambda x: F.array(x)).alias("embeddings"))
    out = model.fanned_out(vectors, vectors.select("row_id", F.lit(3).alias("n")))
    return out.select("row_id", "row", F.get("embedding", F.lit(0)).cast("double").alias("value"))


def _page(method, url, body):
    return (404, "") if url.endswith("/none") else (200, f"{method} {url}")


@query("""SELECT row_id::BIGINT AS row_id, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status_code, CASE WHEN page_id % 5 = 0 THEN 'status 404' END AS error, CASE WHEN page_id % 5 <> 0 THEN 'GET ' || url END AS body
FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS row_id FROM pages)""")
def http_live(spark, sf_dir):
    """Requests of a fetcher in each task."""
    pages = table(spark, sf_dir, "pages")
    asked = rows.numbered(pages.select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.col("url"), F.lit("/none"))).otherwise(F.col("url")).alias("value")), "page_id")
    return http.fetch(asked.select("row_id", "value"), http.HttpRequest("{query}"), _page).select("row_id", "status_code", "error", "body")


@query(f"SELECT i::BIGINT AS row_id, 'POST http://stub/' || name AS value FROM {_REGIONS}")
def http_workflow(spark, sf_dir):
    flow = from_yaml("inputs: {n: [x]}\nops: [{id: h, op: HttpFetchOp, url: 'http://stub/{query}', method: POST, body: '{{\"q\": 1}}', query: n}]\noutputs: [{name: h, ref: h}]")
    return Engine(spark, fetcher=_page).run(flow, n=REGIONS)["h"]


# Sinks


@query(f"SELECT 'item-' || lpad((i + 1)::VARCHAR, 6, '0') || '.txt' AS file, name || chr(10) || 'end' AS content FROM {_REGIONS}")
def value_files(spark, sf_dir):
    """A file per value, read back with its line ends."""
    folder = f"{_shared(spark)}/values-{uuid.uuid4().hex}/"
    tables.write_values(rows.literal(spark, [f"{n}\nend" for n in REGIONS]), folder)
    found = retrieval.objects(spark, folder, "item-*.txt")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.rtrim(F.decode("content", "UTF-8"), F.lit("\u0000")).alias("content"))


@query(f"SELECT 'd' AS output, name || '?' || name || '?' AS line FROM {_REGIONS} UNION ALL SELECT 'again', name || '?' FROM {_REGIONS}")
def output_folders(spark, sf_dir):
    """All outputs of a run, each in a folder of its own."""
    folder = f"{_shared(spark)}/outputs-{uuid.uuid4().hex}"
    flow = from_yaml(_DIAMOND.replace("{name: d, ref: d}", "{name: d, ref: d}, {name: again, ref: c}"))
    written = tables.write_outputs(Engine(spark).run(flow, x=REGIONS), folder)
    read = [spark.read.text(w).select(F.lit(w.rsplit("/", 1)[-1]).alias("output"), F.col("value").alias("line")) for w in written]
    return read[0].union(read[1])


def _shared(spark) -> str:
    cut(spark.range(1))  # sets the folder where it is unset
    return spark.sparkContext.getCheckpointDir()


# Rounds


@query(f"SELECT 'a' AS step, i::BIGINT AS row_id, name || '!' AS value FROM {_REGIONS} UNION ALL SELECT 'b', i, md5('user: ' || name || '!') FROM {_REGIONS} UNION ALL SELECT 'c', i, '[{{\"n\":' || (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = name) || '}}]' FROM {_REGIONS}")
def planned_rounds(spark, sf_dir):
    """Three rounds: a format, a model step over its export, and a query from the library; then a stop, over a stub service."""
    register(spark, sf_dir, ["nation", "region"])
    answers = [
        {"next": "subgraph", "ops": [{"id": "a", "op": "FormatOp", "template": "{n}!", "format_kwargs": {"n": "name"}}], "export": ["a"]},
        {"next": "subgraph", "ops": [{"id": "b", "op": "LLMChatOp", "prompt": {"template": "{a}", "format_kwargs": {"a": "a"}}}]},
        {"next": "subgraph", "ops": [{"ref": "count", "id": "c", "inputs": ["name"]}]},
        {"next": "STOP"},
    ]
    library = Library({"count": {"op": "DataRetrievalOp", "param_bindings": ["p"], "data_spec": {"mode": "sql", "template": "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = {p}", "params": [{"label": "p"}]}}})

    def post(body):
        k = int(body["messages"][1]["content"].split(".")[0].split()[1])
        return {"choices": [{"message": {"content": f"<think>{k}</think>```json\n{json.dumps(answers[k])}\n```" if k % 2 else json.dumps(answers[k])}}]}

    out = run_rounds(Engine(spark), {"name": REGIONS}, posted_planner(post, "m", "Plan."), library)
    shown = [Frame(out[i], c, None).value().select(F.lit(i).alias("step"), "row_id", (F.to_json("value") if c == "table" else F.col("value")).alias("value")) for i, c in (("a", "output"), ("b", "output"), ("c", "table"))]
    return shown[0].union(shown[1]).union(shown[2])


@query(f"""WITH RECURSIVE t(k, name) AS (SELECT 0, name FROM {_REGIONS} UNION ALL SELECT k + 1, name[3:] FROM t WHERE length(name) > 2 AND k < 9) SELECT k, count(*)::BIGINT AS n, string_agg(name, ',' ORDER BY name) AS names FROM t GROUP BY k""")
def template_rounds(spark, sf_dir):
    """Fixed bodies with round numbers, until a round's list is empty."""
    keep = {"op": "LambdaOp", "mode": "list", "fn_name": "f"}
    template = RoundTemplate(
        {"ops": [{"id": "left_{{round}}", **keep, "inputs": ["name"], "code": "def f(columns):\n    return list(columns[0])"}], "export": ["left_{{round}}"]},
        {"ops": [{"id": "left_{{round}}", **keep, "inputs": ["left_{{prev}}"], "code": "def f(columns):\n    return [x[2:] for x in columns[0] if len(x) > 2]"}], "export": ["left_{{round}}"]},
        "left_{{round}}",
    )
    out = run_template(Engine(spark), {"name": REGIONS}, template)
    found = None
    for i, df in out.items():
        part = df.select(F.lit(int(i.split("_")[1])).alias("k"), F.col("output").alias("name"))
        found = part if found is None else found.union(part)
    return found.groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


_TEMPLATES = {"export missing": ("gone", "list"), "fine": ("left", "list"), "row function": ("left", "row")}


@query("SELECT name, name <> 'fine' AS refused FROM (VALUES ('export missing'), ('fine'), ('row function')) t(name)")
def template_checks(spark, sf_dir):
    def made(stop, mode):
        body = {"ops": [{"id": "left_{{round}}", "op": "LambdaOp", "mode": mode, "inputs": ["name"], "code": "lambda c: c"}], "export": ["left_{{round}}"]}
        return RoundTemplate(body, body, stop + "_{{round}}")

    return spark.createDataFrame([(n, _refused(lambda a=a: made(*a))) for n, a in _TEMPLATES.items()], "name string, refused boolean")


# Profiles and jobs


@query("SELECT * FROM (VALUES ('bool', 'true,false'), ('bounds', '1,9'), ('choice', 'x,y'), ('plain', 'sample')) t(name, \"values\")")
def sample_values(spark, sf_dir):
    fields = [Field("bool", "boolean"), Field("bounds", "integer", 1, 9), Field("choice", "string", candidates=("x", "y")), Field("plain")]
    return spark.createDataFrame([(f.name, ",".join(profile.samples(f))) for f in fields], "name string, values string")


@query("SELECT 'orders' AS step, 5::BIGINT AS variants, true AS costed")
def profile_costs(spark, sf_dir):
    """Variants of a query's places and what Catalyst expects of them; nothing runs."""
    register(spark, sf_dir, ["orders", "customer"])
    found = profile.costs(Engine(spark), from_yaml(DIGEST_WORKFLOW))
    return spark.createDataFrame([(i, n, size > 0) for i, n, size in found], "step string, variants long, costed boolean")


@query("SELECT round(count(*) * (0.05 + 0.01 * avg(length(html)) / 1048576), 9) AS seconds, 3::BIGINT AS longest FROM pages")
def object_costs(spark, sf_dir):
    """What reading all objects costs, and the longest list of a document."""
    store = table(spark, sf_dir, "pages").agg(F.count("*").alias("n"), F.avg(F.char_length("html")).alias("m")).first()
    return spark.createDataFrame([(round(profile.object_cost(store["n"], store["m"]), 9), profile.list_length({"a": [1, {"b": [1, 2, 3]}]}))], "seconds double, longest long")


@query("""SELECT user_id AS job_id, arg_max(event_type, ts::VARCHAR || event_type) AS status, max(ts) AS at, count(*)::BIGINT AS events FROM events GROUP BY user_id""")
def job_log(spark, sf_dir):
    """Each job's status from an append-only log."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"))
    return policies.latest(log)


@query("""SELECT user_id AS job_id, 'failed' AS status FROM (SELECT user_id, arg_max(CASE WHEN event_type = 'view' THEN 'running' ELSE event_type END, ts::VARCHAR || CASE WHEN event_type = 'view' THEN 'running' ELSE event_type END) AS s FROM events GROUP BY user_id) WHERE s IN ('running', 'queued')""")
def interrupted_jobs(spark, sf_dir):
    """Jobs that were under way when the last run ended."""
    status = F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").alias("at"))
    return policies.interrupted(log).select("job_id", "status")


@query("SELECT 3.5::DOUBLE AS area, true AS unknown")
def area_estimate(spark, sf_dir):
    """Longest path times greatest share; unknown where a step's cost is."""
    steps = {"a": (2.0, 0.5, []), "b": (1.0, 0.25, ["a"]), "c": (5.0, 0.5, ["a", "b"][:0]), "d": (4.0, 0.1, ["b"])}
    return spark.createDataFrame([(policies.area(steps), policies.area(steps | {"e": (None, 1.0, [])}) is None)], "area double, unknown boolean")
