"""Quality rules: surface rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and word pairs are hashed into a fixed number of buckets. Over all documents the buckets are counted for the raw corpus, and
for the trusted ones among the labelled rows (the target); a document's score is the mean over its n-grams of
log(P target / P raw), and everything below a fixed threshold is rejected, the same way each time.

Counting combines within tasks, so what is shuffled is at most a row for each bucket and task; the driver sees ``BUCKETS`` rows.

Defined results: a null or empty text has no words, fails the base rules and is rejected; repeated rows each get their row; with no
trusted rows at all every score is 0 and the base rules decide alone; an empty table gives no rows; other columns are kept apart from
the operator's own names. A very long text is held in memory as its words.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, keep, table

BUCKETS = 1 << 14
#: Documents whose labels are read for the target, taken in the order of a hash of their id.
TRUSTED_ROWS = 20_000
#: Strength of the raw corpus as prior of the target's probabilities, in n-grams.
PRIOR = 1000.0
#: Mean log ratio for each n-gram below which a document is rejected.
THRESHOLD = -0.08
SPACE = r"[\x20\x09-\x0D]+"
#: Up to so many repeated windows are looked up one by one; beyond it positions are sorted. Both ways count the same.
FEW = 32


def _words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_w", _words(F.col("_t")))


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words: words in 3-word windows that the text has twice or more."""
    n = F.size("_h")
    df = df.withColumn("_h", F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < n, F.sort_array("_h")).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_d", F.when(F.size("_s") > 1, F.array_distinct(F.filter(F.col("_s"), lambda h, i: (i > 0) & (h == F.get("_s", i - 1))))).otherwise(F.array().cast("array<bigint>")))
    listed = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains("_d", F.get("_h", i)))
    df = df.withColumn("_z", F.when(F.size("_d") > FEW, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter(F.col("_z"), lambda z, k: ((k > 0) & (z["h"] == F.get("_z", k - 1)["h"])) | ((k < n - 1) & (z["h"] == F.get("_z", k + 1)["h"])))
    at = F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= FEW, listed).otherwise(F.sort_array(F.transform(same, lambda z: z["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"))
    return df.withColumn("n_repeat_words", F.aggregate(at, start, step, lambda acc: acc["n"])).drop("_h", "_s", "_d", "_z")


def with_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; ``docs`` has ``with_words``."""
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).withColumn("n_symbols", F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"))
    df = df.withColumn("_l", lines).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    df = _repeat_words(df)
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _grams() -> Column:
    one = F.transform("_w", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    two = F.when(F.size("_w") > 1, F.transform(F.sequence(F.lit(0), F.size("_w") - 2), lambda i: F.pmod(F.xxhash64(F.get("_w", i), F.get("_w", i + 1)), F.lit(BUCKETS)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(one, two)


def fit(docs: DataFrame, labels: DataFrame, *, trusted_rows: int = TRUSTED_ROWS, prior: float = PRIOR) -> list[float]:
    """Log ratio of target and raw probability for each bucket, from all documents."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows).withColumn("_good", F.lit(True))
    grams = with_words(docs.select("doc_id", "text")).join(F.broadcast(trusted), "doc_id", "left").select(F.col("_good").isNotNull().alias("good"), F.explode(_grams()).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("good").alias("target")).collect()  # BUCKETS rows at most
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for b, r, t in counts:
        raw[b], target[b] = r, t
    return ratios(raw, target, prior)


def ratios(raw: list[int], target: list[int], prior: float = PRIOR) -> list[float]:
    import math

    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0.0] * len(raw)
    out = []
    for r, t in zip(raw, target, strict=True):
        p = (r + 1) / (n_raw + len(raw))
        out.append(math.log((t + prior * p) / (n_target + prior) / p))
    return out


def with_score(docs: DataFrame, model: list[float]) -> DataFrame:
    """Adds score, the mean log ratio of the n-grams of a text; ``docs`` has ``with_words``."""
    weights = F.from_json(F.lit(json.dumps(model)), "array<double>")  # folded into one constant
    total = F.aggregate(F.col("_g"), F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
    return docs.withColumn("_g", _grams()).withColumn("score", F.when(F.size("_g") > 0, total / F.size("_g")).otherwise(F.lit(0.0))).drop("_g")


def _rated(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``docs``' columns as one struct ``row`` beside the rule columns, score and kept."""
    model = fit(docs, labels)
    df = with_score(with_rules(with_words(apart(docs, text=F.col("text")))), model)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("_t", "_w", "text")


def rate(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the rule columns, score and kept; columns of these names are replaced, all others keep their values."""
    df = _rated(docs, labels, threshold)
    own = [c for c in df.columns if c != "row"]
    return df.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in own], *own)


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules and the ratio keep, with all their columns."""
    # Written first: a filter on the verdict would be pushed through all its steps, and its expression would grow with each.
    df = keep(_rated(docs, labels, threshold).select("row", "kept"), "rated")
    return df.where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
