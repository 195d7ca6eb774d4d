"""Row predicates and small classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_error(mode: str = "status") -> Column:
    """Two tests are in use: ``status`` is "error", or ``error_type`` is set and not the text "None"."""
    if mode == "status":
        return F.coalesce(F.col("status") == "error", F.lit(False))
    if mode == "error_type":
        return F.col("error_type").isNotNull() & (F.col("error_type") != "None")
    raise ValueError(f"unknown mode {mode!r}")


def is_code_component(component: Column) -> Column:
    """A dotted name without white space."""
    return component.contains(".") & ~component.rlike(r"\s")


def is_nullish(summary: Column) -> Column:
    """A result summary (struct with type, len and null_pct) that says there was nothing."""
    return summary.isNull() | (summary["len"] == 0) | summary["null_pct"].isNotNull()


def is_test_path(path: Column) -> Column:
    """A directory named for tests, or a file name that marks one; back slashes count as slashes."""
    p = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    return p.rlike(r"(^|/)(tests?|__tests__|testing)/") | p.rlike(r"(^|/)(test_[^/]*|[^/.]*_test(\.[^/]*)?|[^/]*\.(test|spec)\.[^/]*)$")


#: Words by which a query asks for tests.
TEST_WORDS = ("test", "tests", "testing", "spec", "specs", "fixture", "fixtures")


def mentions_tests(query: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(query), r"[^a-z0-9]+"), F.array(*map(F.lit, TEST_WORDS)))


def is_expected_rejection(error_type: Column, message: Column) -> Column:
    """An HTTP exception that states a client error."""
    status = F.regexp_extract(message, r"^\s*(\d{3})\b", 1)
    return F.coalesce(error_type.endswith("HTTPException") & status.rlike("^4"), F.lit(False))


def is_handled(contained: Column) -> Column:
    """Contained for certain: unknown is not enough."""
    return contained.eqNullSafe(F.lit(True))


def blocked_ms(blocked: Column, wall: Column) -> Column:
    """Blocked time within the wall time; 0 where it is missing or senseless."""
    ok = blocked.isNotNull() & ~F.isnan(blocked.cast("double")) & (blocked > 0)
    return F.when(ok, F.least(blocked.cast("double"), F.greatest(wall.cast("double"), F.lit(0.0)))).otherwise(F.lit(0.0))


def is_io(blocked: Column, wall: Column, side_effects: Column, sources: Column) -> Column:
    """Mostly blocked; else it had side effects; else it drew on an outside source."""
    measured = blocked.isNotNull() & (wall > 0)
    return F.when(measured, blocked_ms(blocked, wall) / wall > 0.5).otherwise(
        (F.coalesce(F.size(side_effects), F.lit(0)) > 0) | F.coalesce(F.exists(sources, lambda s: s.rlike("(?i)io|net|read|socket|http|file|db|query")), F.lit(False))
    )


def status_class(status: Column) -> Column:
    return F.when(status.isNull(), "no-response").when(status >= 500, "5xx").when(status >= 400, "4xx").otherwise("ok")


#: Nouns that mark a key as secret when it is one or ends with one.
SECRET_NOUNS = ("password", "passwd", "secret", "token", "apikey", "authorization", "cookie", "credential", "credentials", "privatekey")


def is_secret_key(key: Column) -> Column:
    normal = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    return normal.rlike("(?:" + "|".join(SECRET_NOUNS) + ")$")


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule (name, pattern) that matches."""
    out = None
    for name, pattern in rules:
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def overlaps(start: Column, end: Column, lower: Column, upper: Column) -> Column:
    """An interval that touches [lower, upper]."""
    return (start <= upper) & (end >= lower)


def component_matches(component: Column, module: Column, handler: Column) -> Column:
    """The exact component, or the handler's name within its module."""
    return (component == F.concat_ws(".", module, handler)) | ((F.element_at(F.split(component, r"\."), -1) == handler) & component.startswith(F.concat(module, F.lit("."))))


def containment(outcomes: Column) -> Column:
    """Any ancestor that ended well: true; all seen ancestors failed: false; none seen: null."""
    seen = F.filter(outcomes, lambda x: x.isNotNull())
    return F.when(F.exists(seen, lambda x: x), True).when(F.size(seen) > 0, False).otherwise(F.lit(None).cast("boolean"))


def merged_containment(values: Column) -> Column:
    """Any false: false; else any unknown: unknown; else true."""
    return F.when(F.exists(F.filter(values, lambda x: x.isNotNull()), lambda x: ~x), False).when(F.exists(values, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(True)


def merged_outcome(values: Column) -> Column:
    """The value that all agree on, else null."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.get(values, 0)).otherwise(F.lit(None).cast("boolean"))


def drift_can_explain(expected: Column, got: Column) -> Column:
    """Only a success that turned into a client error, or the reverse, can come from drifted data."""
    ok, client = (lambda s: s.between(200, 299)), (lambda s: s.between(400, 499))
    return F.coalesce((ok(expected) & client(got)) | (client(expected) & ok(got)), F.lit(False))
