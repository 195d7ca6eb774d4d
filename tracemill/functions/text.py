"""Text functions as column expressions: tokens, signatures, redaction, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Identifier tokens in lower case: words of letters and digits, cut again at case and digit borders."""
    words = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    border = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=[^0-9])(?=[0-9])|(?<=[0-9])(?=[^0-9])"
    parts = F.flatten(F.transform(words, lambda w: F.split(w, border)))
    return F.transform(F.filter(parts, lambda w: w != ""), F.lower)


def document_text(name: Column, tags: Column, summary: Column, text: Column) -> Column:
    """What a symbol is indexed by: its name, its tags in brackets, its summary and its text."""
    bracket = F.when(F.size(tags) > 0, F.concat(F.lit("["), F.array_join(tags, " "), F.lit("]")))
    return F.concat_ws(" ", name, bracket, summary, text)


def embed_text(mode: str, kind: Column, name: Column, parent: Column, summary: Column, snippet: Column, chars: int = 2000) -> Column:
    """The text that is embedded: the signature, with a docstring, or all of it."""
    head = F.concat_ws(" ", kind, F.concat_ws(".", parent, name))
    if mode == "signature":
        return F.concat_ws("\n", head, F.substring_index(snippet, "\n", 1))
    if mode == "docstring":
        return F.concat_ws("\n", head, F.substring_index(snippet, "\n", 1), docstring(snippet))
    return F.concat_ws("\n", head, summary, F.substring(snippet, 1, chars))


def docstring(snippet: Column) -> Column:
    """The first documentation block of a snippet; null if there is none."""
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(snippet, p, 1)), F.lit("")) for p in (r'(?s)"""(.*?)"""', r"(?s)'''(.*?)'''", r"(?s)/\*\*(.*?)\*/", r"(?m)((?:^\s*///.*\n?)+)")])
    return F.trim(F.regexp_replace(found, r"(?m)^\s*(?:\*|///)\s?", ""))


def summary(kind: Column, name: Column, snippet: Column) -> Column:
    return F.concat(kind, F.lit(" "), name, F.lit(": "), F.trim(F.substring_index(snippet, "\n", 1)))


def failure_signature(kind: Column, text: Column, extra: Column | None = None) -> Column:
    """24 hexadecimal digits of a failure's kind and its text without figures, case and spacing."""
    normal = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"\s+", " ")), 1, 600)
    return F.substring(F.sha2(F.concat_ws("|", kind, normal, *([] if extra is None else [extra])), 256), 1, 24)


def opportunity_signature(kind: Column, file: Column, name: Column, evidence: Column) -> Column:
    normal = F.regexp_replace(evidence, r"[0-9]+(?:\.[0-9]+)?", "#")
    return F.substring(F.sha2(F.concat_ws("\x00", kind, file, name, normal), 256), 1, 16)


def normal_repr(text: Column) -> Column:
    """A value's text without memory addresses."""
    return F.regexp_replace(text, r" at 0x[0-9a-fA-F]+", "")


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4)


def redacted(text: Column, mark: str = "***") -> Column:
    """Bearer and basic credentials, secrets in key=value and quoted pairs (quoted keys as well), web tokens and URL credentials."""
    out = F.regexp_replace(text, r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+", f"$1 {mark}")
    out = F.regexp_replace(out, r"(?i)\b([A-Za-z0-9_-]*(?:password|passwd|secret|token|api[_-]?key|authorization)[\"']?\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|(?:bearer|basic)\s+[^\s,;&\"'}]+|[^\s,;&\"'}]+)", f"$1{mark}")
    out = F.regexp_replace(out, r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", mark)
    return F.regexp_replace(out, r"([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s:]+:[^/@\s]+@", f"$1{mark}@")


def evidence_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def query_features(query: Column) -> list[Column]:
    return [
        F.substring(F.sha2(query, 256), 1, 16).alias("query_hash"), F.length(query).alias("n_chars"), F.ceil(F.length(query) / 4).alias("n_tokens"),
        F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")).alias("n_words"), query.rlike(r"[a-z][A-Z]|[A-Za-z]_[A-Za-z]|\w\.\w|\w\(").alias("has_identifier"),
    ]


def joined_route(prefix: Column, path: Column) -> Column:
    """Two route parts with one slash between them and none at the end."""
    route = F.regexp_replace(F.concat_ws("/", prefix, path), "/+", "/")
    return F.when(F.regexp_replace(route, "/+$", "") == "", "/").otherwise(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(route, "/+$", ""), "^/", "")))


def module_of(path: Column) -> Column:
    """The dotted module of a source file; a package's own file stands for the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/", "."), r"\.__init__$", "")


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    x, y = (F.slice(F.split(c, "/"), 1, F.greatest(F.size(F.split(c, "/")) - 1, F.lit(0))) for c in (a, b))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))


def chunk_cases(text: Column) -> Column:
    """Every way to cut a text in two, and the cut into single characters."""
    n = F.length(text)
    two = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array(F.substring(text, F.lit(1), k), F.substring(text, k + 1, n)))).otherwise(F.array().cast("array<array<string>>"))
    return F.concat(two, F.array(F.split(text, "")))
