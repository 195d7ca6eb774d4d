import random

from tracemill.operators import reach


def test_names_with_one_ending(spark):
    left, right = ["a/b/c.py", "c.py", "x/c.py", "b/c.py", "ac.py", None], ["b/c.py", "c.py", "q/a/b/c.py", "d.py", None]
    got = {tuple(r) for r in reach.same_endings(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b", "/").collect()}
    assert got == {(x, y) for x in left if x for y in right if y and (x == y or x.endswith("/" + y) or y.endswith("/" + x))}


def plain_endpoints(endpoints, nodes, edges, targets):
    file = dict(nodes)
    norm = lambda p: p.replace("\\", "/").removeprefix("./")
    same = lambda a, b: norm(a) == norm(b) or norm(a).endswith("/" + norm(b)) or norm(b).endswith("/" + norm(a))
    depth = {file[t]: 0 for t in targets if t in file}
    front = set(depth)
    while front:
        front = {file[s] for s, d, k in edges if k == "invoke" and s in file and d in file and file[d] in front and file[s] != file[d]} - set(depth)
        depth |= dict.fromkeys(front, max(depth.values()) + 1)
    found = {e: min(d for f, d in depth.items() if same(f, p)) for e, p in endpoints if any(same(f, p) for f in depth)}
    return {(e, d) for e, d in found.items() if d == min(found.values())}


def test_nearest_endpoints(spark):
    rng = random.Random(4)
    nodes = [(i, f"src/pkg{i % 9}/m{i % 23}.py") for i in range(120)]
    edges = [(rng.randrange(125), rng.randrange(120), rng.choice(["invoke", "invoke", "contains"])) for _ in range(90)]
    endpoints = [(f"GET /{i}", rng.choice([".\\pkg1\\m4.py", f"pkg{i % 9}/m{i % 23}.py", f"src/pkg{i % 9}/m{i % 23}.py", "none.py"])) for i in range(0, 60, 4)]
    hits = 0
    for targets in ([7], [3, 50, 999], [111], [999]):
        args = spark.createDataFrame(endpoints, "endpoint string, file string"), spark.createDataFrame(nodes, "id long, file string"), spark.createDataFrame(edges, "src long, dst long, kind string"), spark.createDataFrame([(t,) for t in targets], "id long")
        got = {tuple(r) for r in reach.reaching_endpoints(*args).collect()}
        assert got == plain_endpoints(endpoints, nodes, edges, targets)
        hits += len(got)
    assert hits


def test_guards_go_one_step(spark):
    imports = [
        ("app/core/security.py", "jwt.utils", 0), ("app/core/security.py", "bcrypt", 1), ("app/core/security.py", "jwt", 2), ("app/crud.py", "os", 0), ("app/crud.py", "app.core.security", 1), ("app/crud.py", "core.security", 2), ("app/main.py", "app.crud", 0),
        ("lib/far.py", "src.app.core.security", 0), ("lib/near.py", "security_x", 0), ("lib/hm.py", "hmac", 0), ("lib/hm2.py", "hmacs", 0), ("lib/none.py", None, 0), ("lib/two.py", "hm", 3), ("lib/two.py", "core.security", 1),
    ]
    got = {r.file: (r.guard, r.via) for r in reach.security_guards(spark.createDataFrame(imports, "file string, module string, place int")).collect()}
    assert got == {"app/core/security.py": ("bcrypt, jwt", None), "app/crud.py": ("bcrypt, jwt", "app.core.security"), "lib/far.py": ("bcrypt, jwt", "src.app.core.security"), "lib/hm.py": ("hmac", None), "lib/two.py": ("bcrypt, jwt", "core.security")}
