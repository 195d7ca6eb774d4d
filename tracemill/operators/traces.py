"""Request traces: spans from logged events, their enclosing spans by time, and what the shapes of traces say about waste."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import materialised
from .ranges import medians

#: Slack of the clock between a call and the call it is in, in ms.
SLACK = 1.5
SPAN = ["session_id", "request_id", "thread_id", "seq", "component", "depth", "parent_component", "start_ms", "duration_ms", "errored", "io", "blocked_ms", "exit_seq"]


def paired_spans(log: DataFrame) -> DataFrame:
    """Finished calls of an event log that records depths, in any order of lines.

    ``log``: session_id, request_id, thread_id, seq (line), event (``enter``, ``exit``), component, depth, parent_component, ts_ms and, at exits, duration_ms, errored, io,
    blocked_ms. An exit ends the latest open enter of its session, request, thread, component and depth; an exit without one and an enter without an exit are left out.
    """
    key = ["session_id", "request_id", "thread_id", "component", "depth"]
    rows = log.where(F.col("event").isin("enter", "exit"))
    is_enter = F.col("event") == "enter"
    level = F.sum(F.when(is_enter, 1).otherwise(-1)).over(Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_level", F.when(is_enter, level).otherwise(level + 1))
    same = Window.partitionBy(*key, "_level").orderBy("seq")
    end = F.lead(F.struct("event", "seq", "duration_ms", "errored", "io", "blocked_ms")).over(same)
    both = rows.withColumn("_end", end).where(is_enter & (F.col("_end.event") == "exit"))
    value = lambda c, other: F.coalesce(F.col(f"_end.{c}"), F.lit(other)).alias(c)
    return both.select("session_id", "request_id", "thread_id", "seq", "component", "depth", "parent_component", F.col("ts_ms").cast("double").alias("start_ms"), value("duration_ms", 0.0), value("errored", False), value("io", False), value("blocked_ms", 0.0), F.col("_end.seq").alias("exit_seq"))


def enclosing_spans(spans: DataFrame, slack: float = SLACK) -> DataFrame:
    """``spans`` with ``parent_seq``: the latest begun span of the caller's name, one level up in the same request (of any thread), that began no later and lasted
    until the span's start, give or take ``slack`` ms. Ties go to the one that ended in a later line. Null: a root.

    Spans of one name and level and the starts that look for them are read as one stream in the order of time. A span that ends no later than one begun after it is never the answer again, nor is one
    that ended before a start; so a task holds the spans of one name and level that are open inside each other, and work grows with the spans, not with how many are open at once.
    """
    until = F.nanvl(F.col("start_ms") + F.col("duration_ms") + slack, F.lit(float("inf")))
    asks = F.when(F.col("depth") > 0, F.col("parent_component"))  # a null name: no span has it
    roles = F.array(F.struct(F.lit(0).alias("asks"), F.col("component").alias("name"), F.col("depth").alias("level")), F.struct(F.lit(1).alias("asks"), asks.alias("name"), (F.col("depth") - 1).alias("level")))
    key = ["session_id", "request_id", "_name", "_level"]
    rows = spans.select(*SPAN, until.alias("_until"), F.explode(roles).alias("_role")).select(*SPAN, "_until", F.col("_role.asks").alias("_asks"), F.col("_role.name").alias("_name"), F.col("_role.level").alias("_level"))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*key, "start_ms", "_until"]])
    rows = rows.where((F.col("_asks") == 1) | known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = [batch.column(c) for c in key]
            changed = reduce(pc.or_, [pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True) for c in names]).to_pylist()
            found = []
            for new, ask, at, end, seq in zip([group != [c[0].as_py() for c in names], *changed], *[batch.column(c).to_pylist() for c in ("_asks", "start_ms", "_until", "seq")], strict=True):
                if new:
                    stack = []
                if ask:
                    while stack and not stack[-1][0] >= at:
                        stack.pop()
                    found.append(stack[-1][1] if stack else None)
                else:
                    while stack and stack[-1][0] <= end:
                        stack.pop()
                    stack.append((end, seq))
            group = [c[n - 1].as_py() for c in names]
            own = batch.filter(pc.equal(batch.column("_asks"), 1)).select(SPAN)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.int64())], names=[*SPAN, "parent_seq"])

    rows = rows.repartition(*key).sortWithinPartitions(*key, "start_ms", "_asks", "exit_seq", "seq")
    return rows.mapInArrow(run, StructType([*spans.select(*SPAN).schema, StructField("parent_seq", LongType())]))


def line_order_spans(log: DataFrame, unmatched: str = "keep") -> DataFrame:
    """Calls of a log without depths, written in the order of the calls: request_id, thread_id, seq, component, ts_ms, parent_seq, depth, exit_seq, duration_ms.

    An enter opens a call in the latest open one of its thread. An exit ends the latest open call of its component; calls opened since then
    lost their exits (null exit_seq) and are closed with it. An exit whose component is not open changes nothing (``keep``) or closes all calls (``clear``).
    Threads are read as sorted streams; a task holds the open calls of one thread.
    """
    if unmatched not in ("keep", "clear"):
        raise ValueError(f"unknown treatment of unmatched exits {unmatched!r}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        thread, stack = None, []
        for frame in frames:
            out = []
            for session, request, name, seq, event, component, ts, ms in frame.itertuples(index=False, name=None):
                if thread != (session, request, name):
                    out += stack
                    thread, stack = (session, request, name), []
                if event == "enter":
                    stack.append([session, request, name, seq, component, ts, stack[-1][3] if stack else None, len(stack), None, None])
                    continue
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][4] == component), None)
                if at is None:
                    if unmatched == "clear":
                        out += stack
                        stack = []
                    continue
                stack[at][8:] = seq, ms
                out += stack[at:]
                del stack[at:]
            if out:
                yield _frame(out)
        if stack:
            yield _frame(stack)

    order = ["session_id", "request_id", "thread_id", "seq"]
    rows = log.where(F.col("event").isin("enter", "exit")).select(*[F.col(c).cast("string") for c in order[:3]], F.col("seq").cast("long"), "event", "component", F.col("ts_ms").cast("double").alias("ts_ms"), F.coalesce(F.col("duration_ms").cast("double"), F.lit(0.0)).alias("duration_ms"))
    return rows.repartition(*order[:3]).sortWithinPartitions(*order).mapInPandas(run, "session_id string, request_id string, thread_id string, seq long, component string, ts_ms double, parent_seq long, depth int, exit_seq long, duration_ms double")


def _frame(rows: list[list]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["session_id", "request_id", "thread_id", "seq", "component", "ts_ms", "parent_seq", "depth", "exit_seq", "duration_ms"])
    return df.astype({"parent_seq": "Int64", "exit_seq": "Int64", "depth": "int32"})


def span_signals(spans: DataFrame, *, repeats: int = 4, samples: int = 3) -> DataFrame:
    """Signals of waste for each component, from spans with their ``parent_seq``.

    component, self_ms (own time of calls without errors), wall_ms, blocked_ms; n_plus_one_ms and n_count (a component called ``repeats`` times or more by one call: all but one
    of the calls, and the most of them), n_parent (who made the most); serial_ms and serial_count (I/O calls of one call that ran one after the other: all but
    the longest, given to the caller); wait_ms and wait_count (own time beyond the component's median where it exceeds median + 1.4826 MAD, for calls that are not I/O; ``samples`` calls at least).
    """
    key = ["session_id", "request_id"]
    spans = materialised(spans.select(*key, "seq", "parent_seq", "component", "start_ms", "duration_ms", "errored", "io", "blocked_ms"), "spans")
    up = [*key, F.col("parent_seq").alias("seq")]
    inner = spans.where("parent_seq is not null")
    took = inner.groupBy(*up).agg(F.sum("duration_ms").alias("inner_ms"))
    own = F.greatest(F.col("duration_ms") - F.coalesce("inner_ms", F.lit(0.0)), F.lit(0.0))
    # Files are smaller than their rows: without the hints Spark takes columns of all spans for small enough to broadcast.
    own = materialised(spans.hint("merge").join(took, [*key, "seq"], "left").select("component", "errored", "io", "duration_ms", "blocked_ms", own.alias("own_ms")), "own-times")
    times = own.where("NOT errored").groupBy("component").agg(F.sum("own_ms").alias("self_ms"), F.sum("duration_ms").alias("wall_ms"), F.sum("blocked_ms").alias("blocked_ms"))
    names = spans.select(*key, "seq", F.col("component").alias("caller"))
    groups = inner.where("NOT errored").groupBy(*up, F.col("component").alias("child")).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"), F.min("start_ms").alias("at")).where((F.col("n") >= repeats) & (F.col("ms") > 0))
    short = F.element_at(F.split("caller", r"\."), -1)
    repeated = groups.join(names.hint("merge"), [*key, "seq"]).groupBy(F.col("child").alias("component")).agg(
        F.sum(F.col("ms") * (F.col("n") - 1) / F.col("n")).alias("n_plus_one_ms"), F.max("n").alias("n_count"), F.max_by(short, F.struct("n", -F.col("at"), -F.col("seq"))).alias("n_parent"))
    siblings = Window.partitionBy(*key, "parent_seq").orderBy("start_ms", "seq")
    before = F.lag(F.col("start_ms") + F.col("duration_ms")).over(siblings)
    waits = inner.where("io AND NOT errored AND duration_ms > 0 AND start_ms > 0").select("*", (F.col("start_ms") < before - 1).alias("overlaps"))
    rows = waits.groupBy(*up).agg(F.count("*").alias("n"), (F.sum("duration_ms") - F.max("duration_ms")).alias("saved"), F.max(F.coalesce("overlaps", F.lit(False))).alias("overlaps")).where("n >= 2 AND NOT overlaps AND saved > 0")
    serial = rows.join(names.hint("merge"), [*key, "seq"]).groupBy(F.col("caller").alias("component")).agg(F.sum("saved").alias("serial_ms"), F.max("n").alias("serial_count"))
    usual = own.where("NOT errored AND duration_ms > 0").select("component", "own_ms")
    middle = medians(usual, ["component"], "own_ms", "typical", "own-ranges")
    typical = materialised(middle.where(F.col("n") >= samples).select("component", "typical"), "typical")
    spread = medians(usual.join(typical, "component").select("component", F.abs(F.col("own_ms") - F.col("typical")).alias("off")), ["component"], "off", "mad", "off-ranges")
    bound = typical.join(spread, "component").select("component", "typical", (F.col("typical") + F.col("mad") * 1.4826).alias("bound"))
    late = own.where("NOT errored AND NOT io AND duration_ms > 0").join(bound, "component").where("own_ms > bound").groupBy("component").agg(F.sum(F.col("own_ms") - F.col("typical")).alias("wait_ms"), F.count("*").alias("wait_count"))
    out = reduce(lambda x, y: x.join(y, "component", "full"), [times, repeated, serial, late])
    return out.fillna(0.0, ["self_ms", "wall_ms", "blocked_ms", "n_plus_one_ms", "serial_ms", "wait_ms"]).fillna(0, ["n_count", "serial_count", "wait_count"])


def _on_thread() -> Column:
    share = F.when((F.col("wall_ms") > 0) & (F.col("span_blocked_ms") > 0), 1 - F.col("span_blocked_ms") / F.col("wall_ms")).otherwise(1.0)
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def optimization_candidates(timings: DataFrame, signals: DataFrame, cache: DataFrame, calls: DataFrame, calibration: DataFrame | None = None, *, coverage: float = 0.9, cap: int = 12, allocation_coverage: float = 0.8) -> DataFrame:
    """Components ranked by the time that a change could save: the largest estimate of one kind of waste for each, and of these the first that make up ``coverage`` of the sum, ``cap`` at most.

    ``timings``: component, session_id, at (orders the sessions), calls, total_ms, gc_pause_ms, alloc_bytes; a component's newest session counts. ``signals``: see ``span_signals``.
    ``cache``: component, reclaimable_ms. ``calls``: src, dst. ``calibration``: waste_kind, ratio of measured to predicted time.
    Kinds, the first of equals wins: cache; fanout (calls beyond those of the busiest caller); per-call (own time beyond the median of all components, less what was blocked); n-plus-1; serial-async; wait;
    gc-pressure (share of a session's collection time, where that exceeds the median total of its components, of those that make up ``allocation_coverage`` of its allocations).
    Returns component, waste_kind, predicted_ms, effective_ms, waste_prior, amdahl_ceiling, place.
    """
    latest = timings.groupBy("component").agg(F.max_by(F.struct("session_id", "calls", "total_ms", "gc_pause_ms", "alloc_bytes"), F.struct("at", "session_id")).alias("x")).select("component", "x.*")
    latest = materialised(latest.join(signals.withColumnRenamed("blocked_ms", "span_blocked_ms"), "component", "left"), "latest-timings")
    cost = F.coalesce("self_ms", "total_ms")
    # One row for each component that ran: the statistics below are of components, not of calls.
    typical = medians(latest.where((F.col("calls") > 0) & (cost > 0)).select(F.lit(1).alias("_all"), (cost / F.col("calls")).alias("each")), ["_all"], "each", "typical", "costs").select("typical")
    session = latest.groupBy("session_id").agg(F.max(F.coalesce("gc_pause_ms", F.lit(0.0))).alias("pause"), F.sum(F.greatest(F.coalesce("alloc_bytes", F.lit(0)), F.lit(0))).alias("allocated"))
    middle = medians(latest.where("total_ms > 0").select("session_id", "total_ms"), ["session_id"], "total_ms", "session_median", "session-costs").drop("n")
    heads = Window.partitionBy("session_id").orderBy(F.desc("alloc_bytes"), "component").rowsBetween(Window.unboundedPreceding, -1)
    tops = latest.where("alloc_bytes > 0").select("session_id", "component", "alloc_bytes", F.coalesce(F.sum("alloc_bytes").over(heads), F.lit(0)).alias("before"))
    gc = session.join(middle, "session_id").where("pause > 0 AND allocated > 0 AND session_median > 0 AND pause > session_median").join(tops, "session_id").where(F.col("before") / F.col("allocated") < allocation_coverage)
    gc = gc.select("component", (F.col("pause") * F.col("alloc_bytes") / F.col("allocated")).alias("gc_ms"))
    busiest = calls.select("src", "dst").distinct().join(latest.select(F.col("component").alias("src"), F.col("calls").alias("n")), "src").groupBy(F.col("dst").alias("component")).agg(F.max("n").alias("caller_calls"))
    rows = latest.where("total_ms > 0 AND calls > 0").join(cache.select("component", "reclaimable_ms"), "component", "left").join(busiest, "component", "left").join(gc, "component", "left").join(F.broadcast(typical), how="left")
    many, slow = F.col("calls") / F.col("caller_calls"), F.col("typical") / (cost / F.col("calls"))
    kinds = {
        "cache": F.col("reclaimable_ms"), "fanout": F.when((F.col("caller_calls") > 0) & (many > 1), F.col("total_ms") * (1 - 1 / many)), "per-call": F.when((F.col("typical") > 0) & (cost > 0) & (slow < 1), cost * (1 - slow) * _on_thread()),
        "n-plus-1": F.col("n_plus_one_ms"), "serial-async": F.col("serial_ms"), "wait": F.col("wait_ms"), "gc-pressure": F.col("gc_ms"),
    }
    options = F.array(*[F.struct(F.coalesce(ms, F.lit(0.0)).alias("ms"), F.lit(-i).alias("first"), F.lit(name).alias("kind")) for i, (name, ms) in enumerate(kinds.items())])
    best = rows.select("component", "total_ms", F.array_max(options).alias("x")).where("x.ms > 0").select("component", "total_ms", F.col("x.kind").alias("waste_kind"), F.least("x.ms", "total_ms").alias("predicted_ms"))
    if calibration is None:
        calibration = best.sparkSession.createDataFrame([], "waste_kind string, ratio double")
    ratio = F.when((F.col("ratio") > 0) & ~F.isnan("ratio") & (F.col("ratio") < float("inf")), F.col("ratio")).otherwise(1.0)
    best = materialised(best.join(F.broadcast(calibration.where(F.col("waste_kind").isin(*kinds)).groupBy("waste_kind").agg(F.max("ratio").alias("ratio"))), "waste_kind", "left").select("component", "waste_kind", "predicted_ms", (F.col("predicted_ms") * ratio).alias("effective_ms"), F.least(F.col("predicted_ms") / F.col("total_ms"), F.lit(1.0)).alias("waste_prior")), "candidates")
    whole = best.agg(F.sum("effective_ms").alias("_whole"))
    first = best.orderBy(F.desc("effective_ms"), "component").limit(cap)  # no more than cap can be returned
    upto = Window.orderBy(F.desc("effective_ms"), "component")
    first = first.join(F.broadcast(whole)).withColumn("place", F.row_number().over(upto)).withColumn("_before", F.coalesce(F.sum("effective_ms").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ceiling = 1 / F.greatest(F.lit(1e-6), 1 - F.col("effective_ms") / F.col("_whole") * F.col("waste_prior"))
    return first.where(F.col("_before") / F.col("_whole") < coverage).select("component", "waste_kind", "predicted_ms", "effective_ms", "waste_prior", ceiling.alias("amdahl_ceiling"), "place")
