"""Decisions of freshness: one root's state by itself, and the stream with its timers."""

import time

from stratagraph.streaming.freshness import Refresher, Root


def test_a_root_from_change_to_fresh():
    r = Root()
    assert r.take("changed", 1, "a.ts") == [("stale", 0, 0, [])] and r.waits
    assert r.take("changed", 2, "b.ts") == [] and r.take("changed", 2, "again.ts") == []
    assert r.still() == [("run", 0, 1, ["a.ts", "b.ts"])] and not r.waits and r.still() == []
    assert r.take("done", generation=0, run=1) == [("fresh", 0, 1, [])] and r.take("done", generation=0, run=1) == []


def test_changes_during_a_run_start_another():
    r = Root()
    r.take("changed", 1, "a")
    r.still()
    assert r.take("changed", 2, "c") == [] and not r.waits
    assert r.take("done", generation=0, run=1) == [("stale", 0, 1, [])]
    assert r.still() == [("run", 0, 2, ["c"])]
    assert r.take("done", generation=0, run=1) == []  # the first run's end, told twice
    assert r.take("done", generation=0, run=2) == [("fresh", 0, 2, [])]


def test_a_failed_run_gives_its_changes_back():
    r = Root()
    r.take("changed", 1, "a")
    r.still()
    r.take("changed", 2, "b")
    assert r.take("failed", generation=0, run=1) == [("failed", 0, 1, [])] and r.waits
    assert r.still() == [("run", 0, 2, ["a", "b"])]


def test_a_switch_discards_what_ran_before():
    r = Root()
    r.take("changed", 1, "a")
    r.still()
    assert r.take("switch", 2) == [("switched", 1, 1, [])] and not r.waits
    assert r.take("done", generation=0, run=1) == [("discarded", 0, 1, [])] and r.state == "stale"
    r.take("changed", 3, "new")
    assert r.still() == [("run", 1, 2, ["new"])]


def test_the_stream(spark, tmp_path):
    """Two roots; one run fails at first; a second start of the stream goes on from the state."""
    runs = []

    def analyze(root, paths):
        runs.append((root, paths))
        if root == "x" and len([r for r in runs if r[0] == "x"]) == 1:
            raise ValueError("broken")

    def until(condition, seconds=60):
        end = time.time() + seconds
        while not condition() and time.time() < end:
            time.sleep(0.2)
        assert condition(), (runs, refresher.log)

    refresher = Refresher(spark, str(tmp_path), analyze, debounce_ms=300)
    query = refresher.start("200 milliseconds")
    try:
        refresher.tell(("x", 1, "changed", "a.ts", None, None), ("x", 2, "changed", "b.ts", None, None), ("y", 1, "changed", "c.ts", None, None), (None, 1, "changed", "lost", None, None))
        until(lambda: {e[:2] for e in refresher.log} >= {("x", "failed"), ("x", "fresh"), ("y", "fresh")})
    finally:
        query.stop()
    assert sorted(runs) == [("x", ["a.ts", "b.ts"]), ("x", ["a.ts", "b.ts"]), ("y", ["c.ts"])]
    query = refresher.start("200 milliseconds")
    try:
        refresher.tell(("x", 2, "changed", "repeated", None, None), ("x", 3, "changed", "d.ts", None, None))
        until(lambda: ("x", ["d.ts"]) in runs)
        until(lambda: [e[1] for e in refresher.log if e[0] == "x"].count("fresh") == 2)
    finally:
        query.stop()
    assert len(runs) == 4
