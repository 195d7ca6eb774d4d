import os
import time

from tracemill.sources import growing


def touch(path, data, mode="wb"):
    with open(path, mode) as f:
        f.write(data)
    later = time.time() + touch.steps
    touch.steps += 2
    os.utime(path, (later, later))


touch.steps = 0


def test_each_line_is_read_once(spark, tmp_path):
    a, b, c = (str(tmp_path / f"{n}.jsonl") for n in "abc")
    folder = f"file://{tmp_path}"

    def step(manifest):
        lines, after = growing.scan(spark, folder, manifest)
        got = sorted((os.path.basename(r.path), r.line) for r in lines.collect())
        rows = after.collect()
        assert len({r.path for r in rows}) == len(rows)
        return got, spark.createDataFrame(rows, growing.MANIFEST)

    touch(a, b'{"n": 1}\n{"n": 2}\r\n\n  \n{"n": 3')
    touch(b, "ü 中\nsecond\n".encode())
    touch(str(tmp_path / "other.txt"), b"not read\n")
    got, m = step(None)
    assert got == [("a.jsonl", '{"n": 1}'), ("a.jsonl", '{"n": 2}'), ("b.jsonl", "second"), ("b.jsonl", "ü 中")]
    assert step(m)[0] == []  # nothing changed
    touch(a, b'}\n{"n": 4}\n', "ab")  # the open line is ended, another one follows
    got, m = step(m)
    assert got == [("a.jsonl", '{"n": 3}'), ("a.jsonl", '{"n": 4}')]
    touch(b, b"new file under the old name\n" + b"x" * 50)  # longer than before, but another one
    touch(c, b"")
    got, m = step(m)
    assert got == [("b.jsonl", "new file under the old name")]
    touch(b, b"new")  # cut short
    touch(a, b"", "ab")
    got, m = step(m)
    assert got == []
    touch(b, b" again\n", "ab")
    touch(c, b"first of c\n", "ab")
    os.remove(a)
    got, m = step(m)
    assert got == [("b.jsonl", "new again"), ("c.jsonl", "first of c")]
    assert {os.path.basename(r.path): r.offset for r in m.collect()} == {"b.jsonl": 10, "c.jsonl": 11}


def test_large_files_and_many_lines(spark, tmp_path):
    path = str(tmp_path / "big.jsonl")
    touch(path, b"".join(b"line %d of a long log\n" % i for i in range(50_000)))
    lines, manifest = growing.scan(spark, f"file://{tmp_path}")
    manifest = spark.createDataFrame(manifest.collect(), growing.MANIFEST)
    assert lines.count() == 50_000
    touch(path, b"".join(b"line %d of a long log\n" % i for i in range(50_000, 50_100)), "ab")
    lines, _ = growing.scan(spark, f"file://{tmp_path}", manifest)
    assert [r.line for r in lines.orderBy("pos").collect()] == [f"line {i} of a long log" for i in range(50_000, 50_100)]
