"""Secret scans with DataFrame functions only.

Three patterns with fixed meaning (assignments, access keys, long hex strings) and a method for the rest: candidate strings are
slid over with a window whose Shannon entropy, by character class, is kept up to date from incremental counts; strings
that an allow-list knows are suppressed. No shuffle and no Python: one projection.

Defined results: a null text counts as empty and has no span; repeated rows each get their row; an empty table gives none; offsets
are code points of the original text, end exclusive; other columns keep their values, whatever they are called (``find_secrets``
replaces columns called base and added). The work grows with n log n in a text's length and in its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, let, running, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs too short for their kind never match, so the bounds are in the pattern; an assignment's short value still uses up its text.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy in bits of some window, by character class. The most that 20 characters can have is 4.32, and 10 digits 3.32.
HEX_BITS, MIXED_BITS = 3.0, 3.7
ALLOWED = r"(?i)example|sample|dummy|placeholder|change_?me|your[_-]?|redacted|x{6}|0123456789|123456789|abcdefgh|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MARK = "[SECRET]"
#: Code points of the pieces that a text is cut from when it is put together anew.
CHUNK = 4096
_FAR = 1 << 62
_SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string,value:string>>"


def _spans(text: Column, pattern: str, kind: str, order: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: offsets are running sums of the pieces between matches and the matches."""
    none = F.array().cast(_SPAN)

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, x: (F.length(g) + F.length(x)).cast("long")), lambda a, b: a + b, 0)
        parts = F.arrays_zip(ends.alias("end"), found.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
        return F.transform(parts, lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed).cast(_SPAN)).otherwise(none)


def _outside(spans: Column, base: Column) -> Column:
    """The ``spans`` that meet none of ``base``: both are sorted together, and the base ends so far and the base starts to come decide."""

    def alone(both: Column) -> Column:
        before = running(F.transform(both, lambda x: F.when(x["ord"] < 3, x["end"]).otherwise(F.lit(-1))), F.greatest, -1)
        after = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["ord"] < 3, x["start"]).otherwise(F.lit(_FAR)))), F.least, _FAR))
        each = F.arrays_zip(both.alias("span"), before.alias("before"), after.alias("after"))
        return F.transform(F.filter(each, lambda x: (x["span"]["ord"] == 3) & (x["before"] <= x["span"]["start"]) & (x["after"] >= x["span"]["end"])), lambda x: x["span"])

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(F.sort_array(F.concat(base, spans)), alone).cast(_SPAN)).otherwise(spans)


def window_entropy(value: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy in bits of ``width`` characters in a row, from counts updated as the window slides."""
    codes = F.transform(F.split(value, ""), F.ascii)
    bits = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), codes.alias("codes"))

    def step(acc: Column, i: Column) -> Column:
        new = F.get(acc["codes"], i)
        old = F.when(i >= width, F.get(acc["codes"], i - width)).otherwise(F.lit(-1))
        n_new = F.get(acc["counts"], new)
        n_old = F.when(old >= 0, F.get(acc["counts"], old))
        total = F.when(new == old, acc["sum"]).otherwise(acc["sum"] + bits(n_new + 1) - bits(n_new) + F.coalesce(bits(n_old - 1) - bits(n_old), F.lit(0.0)))
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
        best = F.when(i >= width - 1, F.greatest(acc["best"], F.log2(F.lit(float(width))) - total / width)).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"), acc["codes"].alias("codes"))

    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), start, step, lambda acc: acc["best"])


def _suspicious(x: Column) -> Column:
    v = x["value"]
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    least = F.when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS))
    return F.when(mixed & ~v.rlike(ALLOWED), window_entropy(v) >= least).otherwise(F.lit(False))


def _found(docs: DataFrame) -> DataFrame:
    """(row, t, base, added): ``docs``' columns as one struct, the text, and its spans."""
    df = apart(docs, t=F.coalesce(F.col("text").cast("string"), F.lit("")))
    t = F.col("t")
    df = df.select("row", "t", F.filter(_spans(t, ASSIGN, "assign", 0, 1), lambda x: F.length(x["value"]) >= 6).alias("assign"), _spans(t, ACCESS, "access", 1).alias("access"), _spans(t, HEX, "hex", 2).alias("hex"), _spans(t, CANDIDATE, "entropy", 3).alias("candidates"))
    df = df.select("row", "t", F.sort_array(F.concat("assign", "access", "hex")).alias("base"), "candidates")
    added = F.when(F.size("candidates") > 0, F.filter(_outside(F.col("candidates"), F.col("base")), _suspicious)).otherwise(F.array().cast(_SPAN))
    return df.select("row", "t", "base", added.alias("added"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with base (spans of the three kinds) and added (spans of high entropy outside them), by start and kind."""
    return _found(docs.drop("base", "added")).select("row.*", "base", "added")


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text given in chunks of CHUNK."""
    part = lambda j: F.substring(F.get(chunks, j), (F.greatest(start - j * CHUNK, F.lit(0)) + 1).cast("int"), (F.least(end - j * CHUNK, F.lit(CHUNK)) - F.greatest(start - j * CHUNK, F.lit(0))).cast("int"))
    at = lambda x: F.floor(x / CHUNK).cast("int")
    return F.when(end > start, F.array_join(F.transform(F.sequence(at(start), at(end - 1)), part), "")).otherwise(F.lit(""))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one) and n_chars, if there, brought up to date."""
    found = _found(docs).select("row", "t", F.sort_array(F.concat("base", "added")).alias("spans"))
    hit = F.size("spans") > 0
    found = found.select("row", "t", "spans", F.when(hit, F.regexp_extract_all("t", F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("chunks"), F.when(hit, running(F.col("spans.end"), F.greatest, 0)).alias("ends"))
    before = F.transform("spans", lambda x, i: F.struct(F.coalesce(F.get("ends", i - 1), F.lit(0).cast("long")).alias("at"), x["start"].alias("start")))
    kept = F.transform(F.filter(before, lambda x: x["start"] >= x["at"]), lambda x: F.concat(_cut(F.col("chunks"), x["at"], x["start"]), F.lit(mark)))
    whole = F.concat(F.array_join(kept, ""), _cut(F.col("chunks"), F.array_max("ends"), F.length("t").cast("long")))
    out = found.select("row", F.when(hit, whole).alias("new"))
    text = F.coalesce("new", F.col("row.text")).alias("text")
    n_chars = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[text if c == "text" else n_chars if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "added"))).alias("spans"))
