import json
import math
import random

from pyspark.sql import functions as F

from tracemill.operators import joining

RESPONSES = "key long, endpoint string, status int, body string, input_size int, output_size int"
INVARIANTS = "endpoint string, field string, kind string, support long, confidence double, values array<string>, low double, high double"


def test_qualified_names(spark):
    rows = [("app.api.run", "app.api", "run", True), ("app.api.Job.run", "app.api", "run", True), ("src.app.api.run", "app.api", "run", True), ("api.run", "app.api", "run", True), ("app.api.Job.Inner.run", "app.api", "run", False), ("app.api.run", "app.api", "ran", False), ("myapp.api.run", "app.api", "run", False), ("run", "app", "run", False)]
    df = spark.createDataFrame(rows, "component string, module string, name string, expected boolean")
    assert df.where(F.coalesce(joining.qualified_match(F.col("component"), F.col("module"), F.col("name")), F.lit(False)) != F.col("expected")).count() == 0


def test_chunks_of_components(spark):
    rng = random.Random(3)
    chunks = [(i, rng.choice(["run", "get", "save"]), "/".join(rng.choices(["app", "api", "core", "job"], k=3)) + rng.choice(["/x.py", "\\job.py"])) for i in range(60)] + [(99, "only", "q.py")]
    comps = [".".join([*rng.choices(["app", "api", "core", "job", "zz"], k=rng.randrange(4)), rng.choice(["run", "get", "save", "none"])]) for _ in range(80)] + ["a.only", "only", None]

    def best(c):
        short, outer = c.split(".")[-1], c.split(".")[:-1]
        cands = [x for x in chunks if x[1] == short]
        return max(cands, key=lambda x: (sum(s in x[2].replace("\\", "/") for s in outer), -x[0]))[0] if cands else None

    got = {r.component: r.id for r in joining.component_chunks(spark.createDataFrame([(c,) for c in comps], "component string"), spark.createDataFrame(chunks, "id long, name string, file string")).collect()}
    assert got == {c: best(c) for c in comps if c and best(c) is not None}


def test_overlay_of_the_component_or_of_what_it_is_in(spark):
    overlay = spark.createDataFrame([("a.b", 1, "x"), ("a.b.c", 2, "y"), ("a", 3, "z")], "component string, line int, file string")
    comps = spark.createDataFrame([("a.b.c", 0), ("a.b.d", 1), ("a.b.d.e", 2), ("a.q", 3), ("a", 4), ("q", 5), (None, 6)], "component string, k int")
    got = {r.k: r.overlay and tuple(r.overlay) for r in joining.overlay_lookup(comps, overlay).collect()}
    assert got == {0: (2, "y"), 1: (1, "x"), 2: None, 3: (3, "z"), 4: (3, "z"), 5: None, 6: None}


def plain(responses, invariants):
    out = {}
    for key, endpoint, status, body, given, made in responses:
        if status is None or not 200 <= status < 400:
            continue
        try:
            v = json.loads(body)
        except (TypeError, ValueError):
            v = None
        record = v if isinstance(v, dict) else v[0] if isinstance(v, list) and v and isinstance(v[0], dict) else {}
        found = set()
        for e, field, kind, n, sure, values, low, high in invariants:
            luck = {"numeric_bound": 2 / (n + 1), "stable_enum": len(values or []) / n if n else 1.0}.get(kind, 2.0**-n) if n else 1.0
            if e != endpoint or sure < 0.8 or luck > 0.1:
                continue
            x = record.get(field)
            if kind == "never_null" and record and x is None:
                found.add(f"{kind} {field}")
            elif kind == "stable_enum" and values and isinstance(x, str | bool) and (str(x).lower() if isinstance(x, bool) else x) not in values:
                found.add(f"{kind} {field}")
            elif kind == "numeric_bound" and not (field == "id" or field.endswith("_id")) and isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x) and not low <= x <= high:
                found.add(f"{kind} {field}")
            elif kind == "size_relation" and (given or 0) > 0 and (made or 0) > given:
                found.add(kind)
        if found:
            out[key] = "; ".join(sorted(found))
    return out


def test_violations_equal_plain_checks(spark):
    rng = random.Random(7)
    value = lambda: rng.choice([None, True, "a", "b", "c", 1, 5, 99.5, -3, [1], {"x": 1}, "1"])
    record = lambda: {k: value() for k in rng.sample(["state", "size", "user_id", "note"], rng.randrange(1, 5))}
    body = lambda: rng.choice([lambda: json.dumps(record()), lambda: json.dumps([record(), record()]), lambda: "[]", lambda: "{}", lambda: "not json", lambda: None, lambda: "[1]"])()
    responses = [(i, rng.choice(["GET /a", "GET /a", "POST /b", "GET /c"]), rng.choice([200, 200, 201, 302, 404, None]), body(), rng.choice([None, 0, 3]), rng.choice([None, 2, 9])) for i in range(400)]
    invariants = [
        ("GET /a", "state", "never_null", 10, 0.9, None, None, None), ("GET /a", "state", "stable_enum", 40, 0.9, ["a", "true"], None, None), ("GET /a", "size", "numeric_bound", 30, 0.9, None, 0.0, 5.0), ("GET /a", "user_id", "numeric_bound", 30, 0.9, None, 0.0, 1.0),
        ("POST /b", "note", "never_null", 3, 0.9, None, None, None), ("POST /b", "size", "numeric_bound", 5, 0.9, None, 0.0, 0.0), ("POST /b", "state", "stable_enum", 8, 0.9, ["a"], None, None), ("POST /b", None, "size_relation", 9, 0.95, None, None, None), ("POST /b", "size", "never_null", 9, 0.5, None, None, None),
    ]
    r, i = spark.createDataFrame(responses, RESPONSES), spark.createDataFrame(invariants, INVARIANTS)
    got = {x.key: x.violations for x in joining.invariant_violations(r, i).collect()}
    assert got == plain(responses, invariants) and len({v for v in got.values()}) > 3
    assert joining.invariant_violations(r, i.limit(0)).count() == 0 and joining.invariant_violations(r.limit(0), i).count() == 0
