import hashlib
import json
import random

from tracemill.operators import shapes

RESPONSES = "key long, body string, content_type string"


def plain(value, depth=0):
    if depth > 8:
        return "…"
    if isinstance(value, bool):
        return "boolean"
    if value is None:
        return "null"
    if isinstance(value, list):
        return "[" + "|".join(sorted({plain(v, depth + 1) for v in value})) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v, depth + 1)}" for k, v in sorted(value.items())) + "}"
    return "string" if isinstance(value, str) else "number"


def made(rng, depth):
    kind = rng.randrange(8 if depth < 12 else 5)
    if kind > 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else {rng.choice(["a", "b", "ü", "a b", "é.x", "0"]): made(rng, depth + 1) for _ in range(rng.randrange(4))}
    return rng.choice([None, True, False, 3, -2.5, 1e30, "", "text", "{", "12345678901234567890"])


def test_signatures_of_deep_bodies(spark):
    rng = random.Random(12)
    values = [made(rng, 0) for _ in range(150)] + [{"x": {"y": [[[[[[[[1]]]]]]]]}}, [], {}, [[], {}], "s", 0, None, [1, "1", None, 1.5, True]]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)]
    got = dict(map(tuple, shapes.shape_signatures(spark.createDataFrame(rows, "key long, body string")).collect()))
    assert got == {i: plain(v) for i, v in enumerate(values)}


def test_order_of_keys_and_number_of_elements_make_no_difference(spark):
    large = [{"id": i, "tags": ["a"] * (i % 3)} for i in range(3000)]
    rows = [(1, '{"b": [1, 2], "a": {"y": 1, "x": "s"}}'), (2, '{"a":{"x":"t","y":2.5},"b":[7]}'), (3, json.dumps(large)), (4, json.dumps(large[:3]))]
    got = dict(map(tuple, shapes.shape_signatures(spark.createDataFrame(rows, "key long, body string")).collect()))
    assert got[1] == got[2] == "{a:{x:string,y:number},b:[number]}" and got[3] == got[4] == "[{id:number,tags:[]}|{id:number,tags:[string]}]"


def test_hashes_of_responses(spark):
    rows = [(1, None, "x"), (2, "", None), (3, '{"a": 1}', None), (4, '{"a": 2}', "application/json; charset=utf-8"), (5, "{broken", "text/plain; q=1"), (6, "hello", None), (7, "17", "application/json"), (8, "17", "text/plain"), (9, "<p>", " ; x"), (10, '{"a":1,"a":2}', "application/json"), (11, '  ["a"]', "")]
    got = dict(map(tuple, shapes.shape_hashes(spark.createDataFrame(rows, RESPONSES)).collect()))
    digest = lambda s: "json:" + hashlib.sha256(s.encode()).hexdigest()[:16]
    assert got == {1: "empty", 2: "empty", 3: digest("{a:number}"), 4: digest("{a:number}"), 5: "raw:text/plain", 6: "raw:unknown", 7: digest("number"), 8: "raw:text/plain", 9: "raw:unknown", 10: "raw:application/json", 11: digest("[string]")}
    assert shapes.shape_hashes(spark.createDataFrame([], RESPONSES)).count() == 0


def test_shapes_of_many_bodies_are_made_in_rounds(spark, monkeypatch):
    """a task holds a share of ``ROUND`` bodies, not of all."""
    rows = [(i, [None, "", '{"a": [1, "x"]}', "{broken", "[]"][i % 5], "text/plain; q=1") for i in range(40)]
    responses = spark.createDataFrame(rows, RESPONSES)
    want = sorted(map(tuple, shapes.shape_hashes(responses).collect()))
    written, write = [], shapes.materialised
    monkeypatch.setattr(shapes, "materialised", lambda df, label, by=None: (written.append(label), write(df, label, by))[1])
    monkeypatch.setattr(shapes, "ROUND", 15)
    assert sorted(map(tuple, shapes.shape_hashes(responses).collect())) == want and len(want) == 40
    assert written.count("shape-round") == 3
