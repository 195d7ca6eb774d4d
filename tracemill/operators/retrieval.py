"""Retrieval: BM25, exact cosine, reciprocal-rank fusion with priors, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised

from ..functions.text import tokens

# Fixed values of the scoring: BM25, fusion, and its priors.
K1, B = 1.5, 0.75
RRF_K, CANDIDATES = 60, 200
RANK_WEIGHT, TEST_PENALTY, CONTEXT_BOOST, ADJACENT_BOOST = 0.02, 0.55, 0.03, 0.015


def postings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, doc_id, tf) and (doc_id, length) of documents (doc_id, text)."""
    each = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    lengths = each.select("doc_id", F.size("tokens").alias("length"))
    return each.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf")), lengths


def bm25(index: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """(doc_id, score) of documents with any query term. The query's terms are few, so their side is broadcast and filters the index first."""
    spark = index.sparkSession
    terms = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(tokens(F.col("q")))).alias("term"))
    hits = index.join(F.broadcast(terms), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    total = lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.join(F.broadcast(df), "term").join(lengths, "doc_id").join(F.broadcast(total)).groupBy("doc_id").agg(F.sum(idf * tf).alias("score"))


def bm25_search(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id, score) straight from documents (doc_id, text): each text is read once, and only the query's terms leave it."""
    spark = docs.sparkSession
    terms = [t for t in (spark.createDataFrame([(query,)], "q string").select(F.array_distinct(tokens(F.col("q")))).first()[0] or [])]
    each = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    each = each.select("doc_id", F.size("t").alias("length"), F.filter("t", lambda x: x.isin(terms)).alias("t"))
    each = materialised(each, "query-terms")
    total = each.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    hits = each.select("doc_id", "length", F.explode("t").alias("term")).groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # the query's terms at most
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.join(F.broadcast(df), "term").join(F.broadcast(total)).groupBy("doc_id").agg(F.sum(idf * tf).alias("score"))


def updated_postings(index: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """The index with changed documents (doc_id, text) put anew and removed ones (doc_id) gone: equal to one built anew."""
    gone = changed.select("doc_id").union(removed.select("doc_id")).distinct()
    return index.join(gone, "doc_id", "left_anti").select("term", "doc_id", "tf").union(postings(changed)[0])


def cosine(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(vec_id, score) by exact cosine; 0 for a vector without length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(x * x for x in query) ** 0.5
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select("vec_id", F.when((norm > 0) & F.lit(size > 0), dot / (norm * size)).otherwise(F.lit(0.0)).alias("score"))


def rrf(scores: DataFrame, key: str, positive: bool = False, candidates: int = CANDIDATES) -> DataFrame:
    """(key, rank, weight): 1 / (60 + rank) of the best candidates; ties go to the lower key. The top-k comes before the numbering."""
    top = (scores.where("score > 0") if positive else scores).orderBy(F.desc("score"), key).limit(candidates)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
    return ranked.select(key, "rank", (1.0 / (RRF_K + F.col("rank"))).alias("weight"))


def fuse(lexical: DataFrame, dense: DataFrame, nodes: DataFrame, key: str, *, ask_tests: bool = False, context: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Fused scores with the graph-rank prior, the test penalty and boosts for the context and what is next to it."""
    a, b = rrf(lexical, key, True).select(key, F.col("weight").alias("_l")), rrf(dense, key).select(key, F.col("weight").alias("_d"))
    out = a.join(b, key, "full_outer").join(nodes, key)
    score = F.coalesce("_l", F.lit(0.0)) + F.coalesce("_d", F.lit(0.0)) + RANK_WEIGHT * F.log1p("rank")
    if not ask_tests:
        score = score * F.when(F.col("is_test"), TEST_PENALTY).otherwise(1.0)
    for rows, boost in ((context, CONTEXT_BOOST), (near, ADJACENT_BOOST)):
        if rows is not None:
            flag = f"_boost{boost}"
            out = out.join(rows.select(key).distinct().withColumn(flag, F.lit(boost)), key, "left")
            score = score + F.coalesce(F.col(f"`{flag}`"), F.lit(0.0))
    return out.select(key, score.alias("score"), F.coalesce("_l", F.lit(0.0)).alias("lexical"), F.coalesce("_d", F.lit(0.0)).alias("dense"))


def swapped_modules(hits: DataFrame, ratio: float = 0.5) -> DataFrame:
    """In a file whose best symbol has enough of its module's score, the two change scores. ``hits``: file, kind, id, score."""
    best = lambda cond: F.max_by(F.struct("id", "score"), F.when(cond, F.struct("score", -F.col("id"))))
    per_file = hits.groupBy("file").agg(best(F.col("kind") == "module").alias("m"), best(F.col("kind") != "module").alias("s"))
    go = (F.col("m.score") > F.col("s.score")) & (F.col("s.score") >= ratio * F.col("m.score"))
    new = F.when(go & (F.col("id") == F.col("m.id")), F.col("s.score")).when(go & (F.col("id") == F.col("s.id")), F.col("m.score")).otherwise(F.col("score"))
    return hits.join(per_file, "file", "left").select("file", "kind", "id", new.alias("score"))


def one_slice_each(hits: DataFrame) -> DataFrame:
    """The best of the slices of one symbol."""
    w = Window.partitionBy("file", "name").orderBy(F.desc("score"), "id")
    return hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def dcg(gains: Column) -> Column:
    return F.aggregate(F.transform(gains, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)


def ndcg(gains: Column, ideal: Column, k: int) -> Column:
    """Discounted gain of the first k against the best order of the known relevances."""
    best = dcg(F.slice(F.reverse(F.array_sort(ideal)), 1, k))
    return F.when(best > 0, dcg(F.slice(gains, 1, k)) / best).otherwise(F.lit(0.0))


def reciprocal_rank(gains: Column) -> Column:
    at = F.array_position(F.transform(gains, lambda g: g > 0), True)
    return F.when(at > 0, 1.0 / at).otherwise(F.lit(0.0))


def evaluate(rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Hit rates, reciprocal rank and discounted gain of (category, gains, ideal), by category and overall, in one pass."""
    each = rows.select("category", reciprocal_rank(F.col("gains")).alias("mrr"), *[F.exists(F.slice("gains", 1, k), lambda g: g > 0).cast("int").alias(f"hit{k}") for k in ks], *[ndcg(F.col("gains"), F.col("ideal"), k).alias(f"ndcg{k}") for k in ks])
    return each.rollup("category").agg(F.count("*").alias("n"), F.avg("mrr").alias("mrr"), *[F.avg(f"hit{k}").alias(f"hit{k}") for k in ks], *[F.avg(f"ndcg{k}").alias(f"ndcg{k}") for k in ks])
