"""A board of opportunities: entries move between states by the events of a ledger and by what each capture session shows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialised

#: Sessions without evidence after which an entry expires, and dispatches of an entry, the first one included.
MISSING_SESSIONS, ATTEMPTS = 3, 2
ENDED = ("expired", "evicted", "exhausted")
REVERTED = ("regressed", "reverted-behavior")
ENTRY = "id string, row long, kind string, status string, dispatched_at double, updated_at double, episode_id string, retry_count int, misses int, last_session string, place long, resolution string, note string, change string"
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _entries(board: DataFrame) -> DataFrame:
    plain = {"retry_count": F.coalesce("retry_count", F.lit(0)), "misses": F.coalesce("misses", F.lit(0)), "change": F.lit(None)}
    kept = [plain.get(n, F.col(n) if n in board.columns else F.lit(None)) for n in _NAMES]
    return board.select(*[c.cast(t).alias(n) for c, (n, t) in zip(kept, (x.split() for x in ENTRY.split(", ")), strict=True)])


def _retried(attempts: Column, most: int, why: Column, session: str, now: float, verdict: Column, when: Column) -> dict[str, Column]:
    """What changes, where ``when`` holds, of an entry whose attempt came to nothing: it is posted again while attempts are left, else it is exhausted."""
    again = attempts + 1 < most
    new = {
        "status": F.when(again, "posted").otherwise("exhausted"), "retry_count": F.when(again, attempts + 1).otherwise(attempts), "misses": F.lit(0), "change": F.when(again, "reopened").otherwise("exhausted"), "resolution": F.coalesce(verdict, F.col("resolution")),
        "last_session": F.lit(session) if session else F.col("last_session"), "updated_at": F.lit(float(now)), "note": F.concat(why, F.when(again, F.format_string("; attempt %d of %d follows", attempts + 2, F.lit(most))).otherwise("; no attempt is left")),
    }
    return {n: F.when(when, c).otherwise(F.col(n)) for n, c in new.items()}


def judged_outcomes(board: DataFrame, events: DataFrame) -> DataFrame:
    """(id, verdict, delta_ms, predicted_ms): which outcome each dispatched entry gets.

    The ``optimization_outcome`` events of a row are taken in the order of their ``place``; each one goes to the first entry of the row that is still dispatched, was dispatched no later than a second after the event (an event without a time
    fits any) and is of its ``waste_kind``, else to the first of any kind. Rows are read as sorted streams, entries first: a task holds the entries of one row.
    """
    entries = board.where("status = 'dispatched'")
    outcomes = events.where("type = 'optimization_outcome' AND row is not null").join(entries.select("row").distinct(), "row", "left_semi")
    one = entries.select("row", F.lit(0).alias("part"), "place", "id", F.col("kind").alias("kind"), F.coalesce("dispatched_at", "updated_at").alias("at"), *[F.lit(None).cast(t).alias(n) for n, t in (("verdict", "string"), ("delta_ms", "double"), ("predicted_ms", "double"))])
    two = outcomes.select("row", F.lit(1).alias("part"), "place", F.lit(None).cast("string").alias("id"), F.col("waste_kind").alias("kind"), F.col("at").cast("double").alias("at"), F.coalesce("verdict", F.lit("resolved")).alias("verdict"), F.col("delta_ms").cast("double"), F.col("predicted_ms").cast("double"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, waiting = None, []
        for frame in frames:
            out = []
            for r, part, _, entry, kind, at, verdict, delta, predicted in frame.itertuples(index=False, name=None):
                if r != row:
                    row, waiting = r, []
                if part == 0:
                    waiting.append((entry, kind, at))
                    continue
                fits = [w for w in waiting if at != at or at is None or w[2] != w[2] or at + 1 >= w[2]]
                if fits:
                    chosen = next((w for w in fits if w[1] == kind), fits[0])
                    waiting.remove(chosen)
                    out.append((chosen[0], verdict, delta, predicted))
            yield pd.DataFrame(out, columns=["id", "verdict", "delta_ms", "predicted_ms"])

    rows = one.unionByName(two).repartition("row").sortWithinPartitions("row", "part", "place", "id")
    return rows.mapInPandas(run, "id string, verdict string, delta_ms double, predicted_ms double")


def reconcile(board: DataFrame, events: DataFrame, fresh: DataFrame | None, session: str, now: float, *, attempts: int = ATTEMPTS, missing: int = MISSING_SESSIONS) -> DataFrame:
    """The board after one look at the ledger and at a capture session, with what happened to each entry in ``change`` (null: nothing).

    ``board``: id, row, kind, status (posted, dispatched, resolved, expired, evicted, exhausted), dispatched_at, updated_at, episode_id, retry_count, misses, last_session, place (order), resolution. ``events``: type, place, row, at (unix time, may be null),
    waste_kind, verdict, delta_ms, predicted_ms, episode_id, bridge_episode_id. ``fresh``: id of what the session still shows, None if that is unknown.

    First outcomes: a dispatched entry is resolved; after a regressed or reverted one it is posted again or, after ``attempts``, exhausted. Then once for each new session: a dispatched entry without any ledger activity since (of its episode,
    where it has one) counts a miss and is taken for hung at ``missing``; a posted or resolved one that the session doesn't show counts a miss and expires at ``missing``; one that it shows starts again at 0; ended ones count on.
    """
    entries = materialised(_entries(board), "board")
    judged = judged_outcomes(entries, events)
    rows = entries.join(judged, "id", "left")
    bad = F.col("verdict").isin(*REVERTED)
    told = F.concat("verdict", F.when(F.col("delta_ms").isNotNull(), F.format_string(" (%d ms measured)", F.round("delta_ms").cast("long"))).otherwise(""))
    rows = rows.withColumns(_retried(F.col("retry_count"), attempts, F.lit("the change was taken back"), session, now, told, F.coalesce(bad, F.lit(False))))
    good = F.col("verdict").isNotNull() & ~bad
    done = {"status": F.lit("resolved"), "resolution": told, "misses": F.lit(0), "change": F.lit("resolved"), "updated_at": F.lit(float(now))}
    rows = rows.withColumns({n: F.when(good, c).otherwise(F.col(n)) for n, c in done.items()}).select(*_NAMES)
    if not session:
        return rows
    rows = materialised(rows, "board")
    ends = events.where(F.col("type").isin("episode_end", "optimization_outcome")).select(F.coalesce(F.col("at").cast("double"), F.lit(float("inf"))).alias("at"), F.array_distinct(F.array("episode_id", "bridge_episode_id")).alias("episodes"))
    by_episode = ends.select("at", F.explode("episodes").alias("episode_id")).where("episode_id <> ''").groupBy("episode_id").agg(F.max("at").alias("last_here"))
    anywhere = ends.agg(F.max("at").alias("last_any"))
    rows = rows.join(by_episode, "episode_id", "left").join(F.broadcast(anywhere))
    last = F.when(F.coalesce("episode_id", F.lit("")) != "", F.col("last_here")).otherwise(F.col("last_any"))
    alive = F.coalesce(last + 1 >= F.coalesce("dispatched_at", "updated_at"), F.lit(False))
    seen_before = F.col("last_session").eqNullSafe(F.lit(session))
    if fresh is None:
        shown, known = F.lit(True), False
    else:
        rows = rows.join(fresh.select("id").distinct().withColumn("_shown", F.lit(True)), "id", "left")
        shown, known = F.coalesce("_shown", F.lit(False)), True
    sent, ended = F.col("status") == "dispatched", F.col("status").isin(*ENDED)
    open_ = ~sent & ~ended & F.lit(known)
    many = F.col("misses") + 1 >= missing
    cases = F.when(sent & seen_before, None).when(sent & alive, F.when(F.col("misses") > 0, "reset")).when(sent, F.when(many, "hung").otherwise("missed"))
    cases = cases.when(ended, F.when(~seen_before, "aged")).when(open_ & shown, F.when(F.col("misses") > 0, "reset")).when(open_ & seen_before, None).when(open_, F.when(many, "expired").otherwise("missed"))
    rows = rows.withColumn("_case", cases)
    rows = rows.withColumns(_retried(F.col("retry_count"), attempts, F.lit("nothing was heard of the attempt"), session, now, F.lit(None).cast("string"), F.coalesce(F.col("_case") == "hung", F.lit(False))))
    case = F.col("_case")
    new = {
        "misses": F.when(case == "reset", 0).when(case.isin("missed", "aged", "expired"), F.col("misses") + 1).otherwise(F.col("misses")), "last_session": F.when(case.isNotNull(), F.lit(session)).otherwise(F.col("last_session")), "status": F.when(case == "expired", "expired").otherwise(F.col("status")),
        "resolution": F.when(case == "expired", F.format_string("not shown by %d sessions", F.col("misses") + 1)).otherwise(F.col("resolution")), "change": F.when(case == "hung", F.col("change")).otherwise(F.coalesce(case, F.col("change"))), "updated_at": F.when(case.isNotNull(), F.lit(float(now))).otherwise(F.col("updated_at")),
    }
    return rows.withColumns(new).select(*_NAMES)


def retired(board: DataFrame, invalid: DataFrame, reason: str, now: float) -> DataFrame:
    """Posted entries on rows of ``invalid`` (row) expire for a stated reason; all others stay as they are."""
    rows = _entries(board).join(invalid.select("row").distinct().withColumn("_bad", F.lit(True)), "row", "left")
    goes = (F.col("status") == "posted") & F.col("_bad").isNotNull()
    new = {"status": F.lit("expired"), "misses": F.lit(0), "resolution": F.lit(reason), "change": F.lit("retired"), "note": F.lit("its evidence does not hold"), "updated_at": F.lit(float(now))}
    return rows.withColumns({n: F.when(goes, c).otherwise(F.col(n)) for n, c in new.items()}).select(*_NAMES)


def dispatched(board: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """Posted entries among ``ids`` (id, episode_id) become dispatched, each from a fresh count of misses; any other status is left alone."""
    rows = _entries(board).join(ids.select("id", F.col("episode_id").alias("_episode"), F.lit(True).alias("_sent")).dropDuplicates(["id"]), "id", "left")
    goes = (F.col("status") == "posted") & F.col("_sent").isNotNull()
    new = {"status": F.lit("dispatched"), "dispatched_at": F.lit(float(now)), "updated_at": F.lit(float(now)), "misses": F.lit(0), "episode_id": F.coalesce("_episode", "episode_id"), "change": F.lit("dispatched")}
    return rows.withColumns({n: F.when(goes, c).otherwise(F.col(n)) for n, c in new.items()}).select(*_NAMES)
