import random

from tracemill.operators import board

ENTRIES = "id string, row long, kind string, status string, dispatched_at double, updated_at double, episode_id string, retry_count int, misses int, last_session string, place long, resolution string"
EVENTS = "type string, place long, row long, at double, waste_kind string, verdict string, delta_ms double, predicted_ms double, episode_id string, bridge_episode_id string"


def plain(entries, events, fresh, session, attempts=2, missing=3):
    """One event after the other, then one entry after the other; (status, retries, misses, session, change)."""
    rows = [dict(zip(("id", "row", "kind", "status", "sent", "updated", "episode", "retries", "misses", "last"), e[:10], strict=True)) | {"change": None} for e in sorted(entries, key=lambda e: (e[10], e[0]))]
    for r in rows:
        r["retries"], r["misses"] = r["retries"] or 0, r["misses"] or 0
        r["since"] = r["sent"] if r["sent"] is not None else r["updated"]

    def again(r):
        tried = r["retries"] + 1
        r["misses"] = 0
        if tried < attempts:
            r.update(status="posted", retries=tried, change="reopened")
        else:
            r.update(status="exhausted", change="exhausted")
        if session:
            r["last"] = session

    for e in sorted(events, key=lambda e: e[1]):
        kind, _, row, at, waste, verdict = e[:6]
        if kind != "optimization_outcome" or row is None:
            continue
        fits = [r for r in rows if r["status"] == "dispatched" and r["row"] == row and (at is None or at + 1 >= r["since"])]
        if fits:
            r = next((x for x in fits if x["kind"] == waste), fits[0])
            if verdict in ("regressed", "reverted-behavior"):
                again(r)
            else:
                r.update(status="resolved", misses=0, change="resolved")
    for r in rows if session else []:
        if r["status"] == "dispatched":
            if r["last"] == session:
                continue
            alive = any(e[0] in ("episode_end", "optimization_outcome") and (not r["episode"] or r["episode"] in e[8:10]) and (e[3] is None or e[3] + 1 >= r["since"]) for e in events)
            if alive:
                if r["misses"]:
                    r.update(misses=0, last=session, change="reset")
            elif r["misses"] + 1 >= missing:
                again(r)
            else:
                r.update(misses=r["misses"] + 1, last=session, change="missed")
        elif r["status"] in board.ENDED:
            if r["last"] != session:
                r.update(misses=r["misses"] + 1, last=session, change="aged")
        elif fresh is not None:
            if r["id"] in fresh:
                if r["misses"]:
                    r.update(misses=0, last=session, change="reset")
            elif r["last"] != session:
                gone = r["misses"] + 1 >= missing
                r.update(misses=r["misses"] + 1, last=session, change="expired" if gone else "missed", status="expired" if gone else r["status"])
    return {r["id"]: (r["status"], r["retries"], r["misses"], r["last"], r["change"]) for r in rows}


def test_reconciliation_equals_a_plain_fold(spark):
    rng = random.Random(6)
    entries = [(f"e{i}", rng.randrange(12), rng.choice("abc"), rng.choice(["posted", "dispatched", "dispatched", "dispatched", "resolved", *board.ENDED]), rng.choice([None, 50.0, 100.0, 150.0]), 90.0, rng.choice([None, "", "x", "y", "silent"]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1, 2]), rng.choice([None, "s1", "s2"]), i, None) for i in range(120)]
    events = [(rng.choice(["optimization_outcome"] * 3 + ["episode_end", "other"]), i, rng.choice([None, *range(14)]), rng.choice([None, 60.0, 99.0, 100.0, 149.0, 200.0]), rng.choice(["a", "b", "z", None]), rng.choice(["proven", "regressed", "reverted-behavior", None]), rng.choice([None, 3.4]), None, rng.choice([None, "x"]), rng.choice([None, "y"])) for i in range(70)]
    rng.shuffle(events)
    b, e = spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(events, EVENTS)
    fresh = {f"e{i}" for i in range(0, 120, 2)}
    seen = set()
    for shown, session, ledger, most in ((fresh, "s2", events, 2), (None, "s2", events, 3), (fresh, "", events, 2), (fresh, "s3", [], 2)):
        f = None if shown is None else spark.createDataFrame([(x,) for x in shown], "id string")
        out = board.reconcile(b, e if ledger else e.limit(0), f, session, 500.0, attempts=most).collect()
        got = {r.id: (r.status, r.retry_count, r.misses, r.last_session, r.change) for r in out}
        assert got == plain(entries, ledger, shown, session, most)
        seen |= {x[4] for x in got.values()}
    assert seen == {None, "resolved", "reopened", "exhausted", "reset", "missed", "aged", "expired"}


def test_outcomes_take_the_kind_they_judged_and_words_are_kept(spark):
    entries = [("p", 1, "cache", "dispatched", 10.0, 0.0, None, 0, 0, None, 1, "old"), ("q", 1, "wait", "dispatched", 10.0, 0.0, None, 1, 0, None, 2, None), ("r", 2, "wait", "posted", None, 0.0, None, 0, 0, None, 3, None)]
    events = [("optimization_outcome", 1, 1, 5.0, "wait", "proven", None, None, None, None), ("optimization_outcome", 2, 1, 12.0, "wait", "regressed", -7.6, 20.0, None, None), ("optimization_outcome", 3, 1, 12.0, "wait", None, None, None, None, None), ("optimization_outcome", 4, 2, 12.0, "wait", "proven", None, None, None, None)]
    got = {r.id: r for r in board.reconcile(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(events, EVENTS), None, "", 1.0).collect()}
    assert (got["q"].status, got["q"].resolution, got["q"].change) == ("exhausted", "regressed (-8 ms measured)", "exhausted") and "no attempt" in got["q"].note
    assert (got["p"].status, got["p"].resolution) == ("resolved", "resolved") and got["r"].status == "posted" and got["r"].updated_at == 0.0


def test_retired_and_dispatched(spark):
    entries = [("p", 1, "k", "posted", None, 0.0, None, 0, 2, None, 1, None), ("q", 1, "k", "resolved", None, 0.0, None, 0, 0, None, 2, None), ("r", 2, "k", "posted", None, 0.0, "old", 0, 1, None, 3, None)]
    b = spark.createDataFrame(entries, ENTRIES)
    gone = {r.id: (r.status, r.resolution, r.misses) for r in board.retired(b, spark.createDataFrame([(1,), (1,)], "row long"), "gate", 9.0).collect()}
    assert gone == {"p": ("expired", "gate", 0), "q": ("resolved", None, 0), "r": ("posted", None, 1)}
    sent = {r.id: (r.status, r.dispatched_at, r.misses, r.episode_id) for r in board.dispatched(b, spark.createDataFrame([("p", "ep"), ("q", "ep"), ("r", None)], "id string, episode_id string"), 7.0).collect()}
    assert sent == {"p": ("dispatched", 7.0, 0, "ep"), "q": ("resolved", None, 0, None), "r": ("dispatched", 7.0, 0, "old")}
