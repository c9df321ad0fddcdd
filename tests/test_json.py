import json
import random

import pytest

from webcorpus import fixed
from webcorpus.operators import comments, extraction, json_nodes, records
from webcorpus.sources import endpoints as sources

RECORD_CASES = [
    # a root array, a price one level down
    ('[{"title": "t", "price": {"amount": 1}, "id": 1}]', [("t", "1", None, "1")]),
    # the array whose objects are longer wins, wherever it is
    ('{"a": [{"name": "short"}], "b": {"c": [{"name": "much longer than that"}]}}', [("much longer than that", None, None, None)]),
    # of equals the last in the document wins
    ('{"a": [{"name": "one"}], "b": [{"name": "two"}]}', [("two", None, None, None)]),
    # names by priority, upper case or not, however deep; fragments of links go
    ('[{"label": "l", "x": {"NAME": "n"}, "href": "http://u/#f", "sku": "s"}]', [("n", None, "http://u/", "s")]),
    # a value below an object: the preferred name first, else the first useful one
    ('[{"title": {"x": "no", "text": "yes"}, "price": [null, " ", 4.5], "id": {"a": {"b": true}}}]', [("yes", "4.5", None, "true")]),
    # the same name twice: the less deep one
    ('[{"a": {"title": "deep"}, "title": "flat"}]', [("flat", None, None, None)]),
    # items that are no objects do not count, nor do those without a field
    ('[1, {"title": "x"}, "s", {"other": 1}, {"title": "  "}, {"title": "y"}]', [("x", None, None, None), ("y", None, None, None)]),
    ('{"no": 1}', []), ("[]", []), ("{bad", []), ('[{"title": "t"}] tail', []), (None, []),
    # a repeated key holds its last value
    ('[{"title": "t", "title": "u"}]', [("u", None, None, None)]),
]


def test_records(spark):
    df = spark.createDataFrame([(k, body) for k, (body, _) in enumerate(RECORD_CASES)], "doc int, body string")
    got = {k: [] for k in range(len(RECORD_CASES))}
    for r in records.flatten_records(df).orderBy("doc", "record").collect():
        got[r.doc].append((r.title, r.price, r.url, r.id))
    for k, (body, want) in enumerate(RECORD_CASES):
        assert got[k] == want, body


def reversed_visits(root):
    """All containers with their depth, the last branch first."""
    yield root, 0
    children = list(root.values()) if isinstance(root, dict) else root
    for child in children[::-1]:
        if isinstance(child, (dict, list)):
            for value, depth in reversed_visits(child):
                yield value, depth + 1


def slow_records(root):
    if not isinstance(root, (dict, list)):
        return None
    sized = [(sum(len(json.dumps(o)) for o in a if isinstance(o, dict)), d, a) for a, d in reversed_visits(root) if isinstance(a, list)]
    sized = [s for s in sized if s[0]]
    if not sized:
        return None
    size, depth, array = max(sized, key=lambda s: s[0])
    lines = []
    for item in (o for o in array if isinstance(o, dict)):
        line = []
        for names, _ in fixed.RECORD_FIELDS.values():
            named = [(names.index(k.lower()), d, v) for o, d in reversed_visits(item) if isinstance(o, dict) for k, v in o.items() if k.lower() in names]
            line.append(min(named, key=lambda n: n[:2])[2] if named else None)
        lines.append(line)
    return size, depth, lines


def test_one_pass_agrees_with_visiting_everything():
    rng = random.Random(9)
    keys = ["title", "Name", "text", "price", "VALUE", "url", "href", "id", "sku", "x", "y\u00e9", "título"]

    def value(depth):
        if depth and rng.random() < 0.6:
            if rng.random() < 0.5:
                return [value(depth - 1) for _ in range(rng.randint(0, 4))]
            return {rng.choice(keys): value(depth - 1) for _ in range(rng.randint(0, 5))}
        return rng.choice(["a", " ", "é", 1, -2.5, True, None, 10**20, "b" * 9])

    plain = lambda v: json.loads(json.dumps(v))
    seen = 0
    for _ in range(2000):
        root = value(6)
        want, got = slow_records(root), records._richest(json.dumps(root))
        assert (want is None) == (got is None)
        if want:
            seen += 1
            items = [o for o in got[2] if isinstance(o, dict)]
            lines = [[None if best is None else plain(best[2]) for best in item.best] for item in items]
            assert (got[0], got[1], lines) == want
    assert seen > 500


def test_deep_documents(spark):
    deep = '[{"title": ' + '{"a": ' * 900 + "[" * 900 + '"t"' + "]" * 900 + "}" * 900 + "}]"
    df = spark.createDataFrame([(1, deep), (2, "[" * 10**6)], "doc int, body string")
    assert [(r.doc, r.title) for r in records.flatten_records(df).collect()] == [(1, "t")]


def test_no_record_is_lost(spark):
    items = [{"title": f"t{k}", "price": {"value": k}} for k in range(1000)]
    df = spark.createDataFrame([("d", json.dumps({"few": [{"title": "x" * 50}], "many": items}))], "doc string, body string")
    rows = records.flatten_records(df).orderBy("record").collect()
    assert [(r.record, r.title, r.price) for r in rows] == [(k, f"t{k}", str(k)) for k in range(1000)]


def test_node_sizes_match_serialised_json(spark):
    doc = {"k": ["é", {"n": 1.5, "b": [True, None]}], "e": {}}
    nodes = json_nodes.walk_json(json.dumps(doc))
    assert nodes[0]["json_len"] == len(json.dumps(doc)) and nodes[1]["json_len"] == len(json.dumps(doc["k"]))
    df = spark.createDataFrame([("d", json.dumps(doc))], "doc string, body string")
    assert json_nodes.count_items(df).first()["items"] == 8


CAPTURED = [
    ("https://shop.ar/list", 0, "https://shop.ar/ping", 200, "application/json", '{"ok": 1}'),
    ("https://shop.ar/list", 1, "https://cdn.io/config", 200, "application/json", '{"cfg": "' + "x" * 300 + '"}'),
    ("https://shop.ar/list", 2, "https://api.shop.ar/api/items", 200, "application/json; charset=utf-8",
     json.dumps({"results": [{"title": f"T{i}", "price": i, "permalink": f"http://s/{i}#t"} for i in range(5)]})),
    ("https://shop.ar/list", 3, "https://www.google-analytics.com/collect", 200, "application/json", '{"a": 1}'),
    ("https://shop.ar/list", 4, "https://shop.ar/ping", 200, "application/json", '{"later": 1}'),
    ("https://shop.ar/list", 5, "https://shop.ar/page", 200, "text/html", "<p>"),
    ("https://shop.ar/list", 6, "https://shop.ar/x.json", 200, "text/plain", "not json"),
    ("https://shop.ar/list", 7, "https://shop.ar/tail.json", 200, "text/plain", '{"a": 1} ' + "junk" * 5000),
    ("https://dead.io/", 0, "https://mixpanel.com/track", 200, "application/json", "{}"),
]


def captured(spark):
    return spark.createDataFrame(CAPTURED, "page_url string, seq int, url string, status int, content_type string, body string")


def test_captured_endpoints(spark):
    kept = sources.read_endpoints(captured(spark))
    assert {r.seq: r.is_json for r in kept.collect()} == {0: True, 1: True, 2: True, 6: False, 7: False}
    ranked = json_nodes.rank_endpoints(json_nodes.score_endpoints(kept)).orderBy("rank").collect()
    assert [r.seq for r in ranked] == [2, 0, 1, 6, 7] and ranked[-1].data_score == ranked[-2].data_score == 0
    size, items = len(CAPTURED[2][5]), 1 + 5 + 15
    assert ranked[0].data_score == size + items * 150 + 12000
    recs, summary = records.capture_records(kept)
    assert [(r.title, r.price, r.url) for r in recs.orderBy("record").collect()] == [
        (f"T{i}", str(i), f"http://s/{i}") for i in range(5)]
    jobs = spark.createDataFrame([("a", "https://shop.ar/list"), ("b", "https://dead.io/")], "job_id string, page_url string")
    rows = {r.job_id: r for r in records.capture_status(jobs, summary).collect()}
    assert rows["a"].api_endpoints == 5 and rows["a"].api_urls[0].endswith("/api/items") and rows["a"].status == "ok"
    assert rows["b"].status == "error" and rows["b"].error


def comment(text, replies="", kind="t1"):
    data = {"author": "u", "body": text, "score": 2, "created_utc": 1700000000.0}
    if replies != "":
        data["replies"] = {"kind": "Listing", "data": {"children": replies}}
    else:
        data["replies"] = ""
    return {"kind": kind, "data": data}


def test_comment_threads(spark):
    tree = [comment("one", [comment("one.a", [comment("one.a.x")]), {"kind": "more", "data": {"id": "z"}}]),
            comment("", [comment("orphan")]), comment("two")]
    body = json.dumps([{"data": {"children": [{"kind": "t3", "data": {"title": "p"}}]}}, {"data": {"children": tree}}])
    df = spark.createDataFrame([("d", body), ("e", '{"x": 1}')], "doc string, body string")
    rows = comments.flatten_comments(df).orderBy("rank").collect()
    assert [r.text for r in rows] == ["one", "one.a", "one.a.x", "two"]
    assert rows[0].score == 2 and rows[0].created_at.year == 2023
    assert comments.flatten_comments(df, max_items=2).count() == 2


def test_uniform_exports(spark):
    df = spark.createDataFrame([("", "id1", "hi", None, 1700000000)], "author string, author_id string, text string, like_count int, timestamp long")
    row = comments.normalize_comments(df, "youtube").first()
    assert (row.author, row.text, row.likes) == ("id1", "hi", 0) and row.created_at.year == 2023
    df = spark.createDataFrame([("u", None, None, True)], "username string, full_name string, is_private boolean, is_verified boolean")
    assert tuple(comments.normalize_follows(df).first()) == ("u", "", False, True)


SCHEMA = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "n": {"type": ["integer", "null"]},
          "in": {"type": "object", "required": ["k"]}}}


def test_answers(spark):
    rows = ['{"name": "a"}', 'Sure:\n```json\n{"name": "b", "n": 2.0}\n```', 'x {"name": "c", "in": {}} y', "nothing", "[1]",
            '{"name": 3, "n": 1.5}', '{"n": null}', None, '{"name": "d"} ok', '{"name": "e", "name": "f"}', '{"name": "g"', '{"name": "' + "h" * 70_000 + '"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    parsed = df.select("i", extraction.parse_answer("raw").alias("a")).select("i", "a.*")
    got = {r.i: r for r in extraction.validate_json(parsed, SCHEMA).collect()}
    assert [got[i].valid for i in range(8)] == [True, True, False, False, False, False, False, False]
    assert [got[i].valid for i in range(8, 12)] == [True, True, False, True]
    assert got[8].json == '{"name": "d"}' and json.loads(got[9].json) == {"name": "f"} and got[10].error == extraction.NOT_JSON
    assert got[2].errors == ["$.in: k is required"] and got[3].error == extraction.NOT_JSON and got[4].error == extraction.NOT_OBJECT
    assert got[5].errors == ["$.name: not string", "$.n: not integer or null"] and got[6].errors == ["$: name is required"]


RULES = [
    ({"type": ["integer", "null"]}, ["1", "null", "2.0"], ["1.5", '"1"', "[]"]),
    ({"enum": ["a", 1, None, True, {"b": [1], "a": 2}]}, ['"a"', "1.0", "true", '{"a": 2, "b": [1]}'], ['"b"', "2", "false", "{}"]),
    ({"const": 3}, ["3", "3.0"], ["4", '"3"']),
    ({"items": {"items": {"type": "integer"}}}, ["[[1], [2, 3]]", "[]", '"no array"'], ['[[1], ["x"]]']),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, ['["a", 1]', "[]"], ["[1]", '["a", "b"]']),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, ["[1]", "[1, 2]", "{}"], ["[]", "[1, 2, 3]", "[1, 1]"]),
    ({"contains": {"const": 2}}, ["[1, 2]", "7"], ["[1]", "[]"]),
    ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, ['"ab"', '"aé😀"', "5"], ['"a"', '"abcd"', '"bb"']),
    ({"minimum": 1, "exclusiveMaximum": 5, "multipleOf": 0.5}, ["1", "4.5", '"x"'], ["0.5", "5", "1.2"]),
    ({"maximum": 5, "exclusiveMinimum": 1}, ["5", "2"], ["1", "5.1"]),
    ({"properties": {"a": {"type": "string"}, "it's": {"const": 1}}, "required": ["a"]}, ['{"a": "x"}', "[]", '{"a": "", "it\'s": 1}'], ["{}", '{"a": 1}', '{"a": "", "it\'s": 2}']),
    ({"properties": {"a": {}}, "patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, ['{"a": 1, "x1": 2}'], ['{"b": 1}', '{"x": "s"}']),
    ({"additionalProperties": {"type": "integer"}, "minProperties": 1, "maxProperties": 2}, ['{"a": 1}'], ["{}", '{"a": "s"}', '{"a": 1, "b": 2, "c": 3}']),
    ({"propertyNames": {"maxLength": 2}}, ['{"ab": 1}', "{}"], ['{"abc": 1}']),
    ({"allOf": [{"type": "integer"}, {"minimum": 2}]}, ["2"], ["1", '"x"']),
    ({"anyOf": [{"type": "string"}, {"minimum": 2}]}, ['"x"', "3"], ["1"]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, ["1", "2.5"], ["3", "1.5"]),
    ({"not": {"type": "string"}, "title": "no rule"}, ["1", "null"], ['"x"']),
]


def test_every_rule_of_a_schema(spark):
    for schema, good, bad in RULES:
        df = spark.createDataFrame([(t, t in good) for t in good + bad], "json string, want boolean")
        rows = extraction.validate_json(df, schema).collect()
        assert all(r.valid == r.want and bool(r.errors) != r.want for r in rows), (schema, rows)


def test_errors_have_places(spark):
    schema = {"properties": {"tags": {"items": {"properties": {"n": {"type": "integer"}}}}, "e": {"enum": ["a"]}}}
    df = spark.createDataFrame([('{"tags": [{"n": 1}, {"n": "x"}], "e": "z"}',), (None,), ("no json",)], "json string")
    rows = extraction.validate_json(df, schema).collect()
    assert rows[0].errors == ["$.tags[1].n: not integer", '$.e: not one of ["a"]'] and not rows[0].valid
    assert not rows[1].valid
    with pytest.warns(UserWarning, match=r"\$\.items: \$ref"):
        extraction.validate_json(df, {"items": {"$ref": "#/x"}, "format": "none"})
    assert extraction.unknown_keywords({"if": {}, "properties": {"a": {"anyOf": [{"then": 1}]}}}) == ["$: if", "$.properties.a.anyOf.0: then"]


def test_answers_in_prose(spark):
    cases = {
        'x {a} {"k": 1} y': '{"k": 1}', '{"g": 1, "in": {"k": 1}': None, 'see [{"k": 1}] there': '{"k": 1}', '```\n{"k": 1}\n```\n{"k": 2}': '{"k": 1}',
        '```json {"k": 1}```': '{"k": 1}', '{"k": "}"} tail }': '{"k": "}"}', "null": None, "": None,
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for r in df.select("raw", "want", extraction.parse_answer("raw").alias("a")).collect():
        assert r.a.json == r.want, r.raw


def test_extraction_with_a_caller_function(spark):
    df = spark.createDataFrame([(1, "ana"), (2, "bad")], "doc_id int, text string")

    def complete(systems, users):
        return ["{}" if "bad" in u else json.dumps({"name": u.split("\n")[1]}) for u in users]

    got = {r.doc_id: (r.json, r.error) for r in extraction.extract_structured(df, SCHEMA, complete).collect()}
    assert got[1] == ('{"name": "ana"}', None) and got[2][0] is None and "required" in got[2][1]
    long = spark.createDataFrame([("x" * 70_000,)], "t string")
    assert long.select(extraction.build_prompt("t", SCHEMA)["user"]).first()[0].count("x") == 70_000
    assert long.select(extraction.build_prompt("t", SCHEMA, limit=60_000)["user"]).first()[0].count("x") == 60_000


def test_answers_are_read_where_they_are_made(spark):
    raw = ['{"a": 1}', '```json\n{"a": 2}\n```', 'so: {"a": 3} it is', "[1]", "nothing", "", None, '{"a": 1, "a": 4}']
    prompts = spark.createDataFrame([(k, "s", str(k)) for k in range(len(raw))], "doc_id int, system string, user string")

    def complete(systems, users):
        return [raw[int(u)] for u in users]

    apart = extraction.complete_with(prompts, complete, "doc_id").select("doc_id", extraction.parse_answer("raw").alias("a")).select("doc_id", "a.*")
    at_once = extraction.complete_with(prompts, complete, "doc_id", read=True)
    assert at_once.schema == apart.schema and sorted(at_once.collect()) == sorted(apart.collect())


def test_richest_array_holds_one_parsed_document():
    import tracemalloc

    import pyarrow as pa

    body = json.dumps([{"title": f"t{i}", "tags": [{"name": "n"}]} for i in range(300)])
    batch = pa.RecordBatch.from_pydict({"doc": list(range(150)), "body": [body] * 150})
    tracemalloc.start()
    out = records._scores(batch, "doc", "body")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 150 and out.column("array_depth").to_pylist() == [0] * 150
    assert peak < 10_000_000  # all of them together take more than ten times that


def test_captured_rows_are_made_once(spark):
    """The first response of a page and URL is found without reading the captured rows a second time."""
    rows = [("p", s, u, 200, "application/json", b) for s, u, b in [(2, "a", "1"), (1, "a", "2"), (1, "a", "3"), (0, None, "4"), (None, "a", "5"), (3, "b", "6")]]
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    schema = "page_url string, seq int, url string, status int, content_type string, body string"
    traffic = spark.createDataFrame([*rows, (None, 0, "c", 200, "application/json", "7")], schema).mapInPandas(seen, schema)
    kept = sources.read_endpoints(traffic).collect()
    assert sorted((r.url, r.seq, r.body) for r in kept) == [("a", 1, "2"), ("a", 1, "3"), ("b", 3, "6")]
    assert made.value == 7
