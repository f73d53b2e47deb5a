import dataclasses
import os
import time
from pathlib import Path

import pytest

from roadpulse.checks.oracle import LEVELS, RULES
from roadpulse.params import CrispParams, FuzzyParams
from roadpulse.plans.replay import replay
from roadpulse.plans.step import interval_step
from roadpulse.sources import incidents as src
from roadpulse.streaming import run
from tests import data, plain

CRISP = CrispParams(radius_miles=1.5, delete_threshold=1.2)
FUZZY = FuzzyParams(radius_miles=3.0, init_miles=1.0, delete_threshold=1.2)
GAPS = [1, 2, 5]  # nothing comes in 3 and 4


def history(n=110, seed=50):
    items = []
    for k, t in enumerate(GAPS):
        items += [
            dict(x, id=x["id"] * 10 + k, t=t) for x in data.rows(n, seed + k, spread=0.12, hot=0.2)
        ]
    return items


def simulate(items, p, upto=GAPS[-1]):
    fuzzy = (RULES[p.rule_base], LEVELS) if isinstance(p, FuzzyParams) else None
    state = {}
    for t in range(1, upto + 1):
        rows = [x for x in items if x["t"] == t]
        if rows or state:
            state = plain.step(state, rows, p, fuzzy)
    return state


def check(df, want, fuzzy=False):
    got = {(r["road_key"], r["lat"], r["lon"]): r for r in df.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        r = got[k]
        assert (str(r["hs_id"]), r["age"]) == (str(w["id"]), w["age"])
        assert r["fitness"] == pytest.approx(w["fitness"], abs=1e-9)
        if fuzzy:
            assert (r["sd"], r["density_label"]) == (pytest.approx(w["sd"]), w["label"])


def final(store):
    return store.read_state(store.latest())


@pytest.mark.parametrize("p", [CRISP, FUZZY], ids=["crisp", "fuzzy"])
def test_replay_with_idle_intervals(spark, tmp_path, p):
    items = history()
    store = replay(data.frame(spark, items), str(tmp_path / "run"), p)
    want = simulate(items, p)
    assert len(want) > 8
    check(final(store), want, isinstance(p, FuzzyParams))
    metrics = {r["interval_id"]: r for r in store.metrics().collect()}
    assert sorted(metrics) == GAPS
    assert all(m["n_incidents"] == 110 for m in metrics.values())
    if isinstance(p, FuzzyParams):
        last = metrics[GAPS[-1]]
        assert len(last["fv_quantiles"]) == 6
        fv = sorted(v["fitness"] for v in want.values())
        assert last["fv_quantiles"][2] == pytest.approx(fv[len(fv) // 2])
        assert last["n_dense"] + last["n_sparse"] == last["n_reported"]


@pytest.mark.parametrize("kind", [CrispParams, FuzzyParams])
def test_bounds_do_not_change_results(spark, tmp_path, kind):
    """Tiny limits send every join and every cluster down the big-data way."""
    items = history(60)
    p = kind(radius_miles=1.5, delete_threshold=1.2, max_group_rows=10, broadcast_rows=0)
    store = replay(data.frame(spark, items), str(tmp_path / "r"), p, last_interval=2)
    check(final(store), simulate(items, p, 2), kind is FuzzyParams)


def test_replay_goes_on_after_a_stop(spark, tmp_path):
    items = history(60)
    df = data.frame(spark, items)
    replay(df, str(tmp_path / "r"), CRISP, last_interval=2)
    check(final(replay(df, str(tmp_path / "r"), CRISP)), simulate(items, CRISP))


def test_retried_batch_and_late_rows(spark, tmp_path):
    items = history(60)
    df = data.frame(spark, items)
    runner = run.IntervalRunner(spark, str(tmp_path / "r"), CRISP, df.schema["incident_id"].dataType)
    runner.run_batch(df.filter("interval_id <= 2"), 0)
    again = run.IntervalRunner(spark, str(tmp_path / "r"), CRISP, df.schema["incident_id"].dataType)
    for _ in range(2):
        again._newest = None
        again.run_batch(df.filter("interval_id = 5 or incident_id % 50 = 0"), 1)
    check(final(again.store), simulate(items, CRISP))
    late = spark.read.parquet(str(tmp_path / "r" / "late")).filter("interval_id <= 2").count()
    assert late == sum(1 for x in items if x["id"] % 50 == 0 and x["t"] <= 2) > 0


def test_stream_restart_equals_replay(spark, tmp_path):
    items = history(60)
    feed = tmp_path / "feed"
    feed.mkdir()
    root, ck = str(tmp_path / "r"), str(tmp_path / "ck")

    def put(t):
        lines = [f"{x['id']},{x['lat']},{x['lon']},{x['bearing']},x,{x['road']}" for x in items if x["t"] == t]
        path = feed / f"inc_{t}.csv"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + t, 1_700_000_000 + t))  # files are taken by age

    def go():
        return run.run_stream(src.stream_incident_csv(spark, str(feed)), root, ck, CRISP)

    put(1)
    go()
    put(2)
    put(5)
    query = go()
    store = run.RunStore(spark, root, data.frame(spark, items[:1]).schema["incident_id"].dataType, False)
    check(final(store), simulate(items, CRISP))
    assert store.hotspots().filter("interval_id = 5").count() == sum(
        v["fitness"] >= 5.0 for v in simulate(items, CRISP).values()
    )
    progress = run.progress_metrics(query).collect()
    assert sum(r["n_rows"] for r in progress) == sum(x["t"] > 1 for x in items)
    kept = store.progress().orderBy("batch_id").collect()
    assert sum(r["n_rows"] for r in kept) == len(items)
    assert [r["batch_id"] for r in kept] == list(range(len(kept)))
    assert all(r["scheduling_ms"] is not None and r["scheduling_ms"] >= 0 for r in kept)


def test_directory_stream_with_a_time_limit(spark, tmp_path):
    """A query that goes on: files that appear are taken, the newest interval
    waits, and the call returns when its time is over."""
    items = history(60)
    feed = tmp_path / "feed"
    feed.mkdir()
    for t in GAPS:
        lines = [f"{x['id']},{x['lat']},{x['lon']},{x['bearing']},x,{x['road']}" for x in items if x["t"] == t]
        path = feed / f"inc_{t}.csv"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + t,) * 2)
    root, began = str(tmp_path / "r"), time.monotonic()
    stream = src.stream_incident_csv(spark, str(feed), 1)
    query = run.run_stream(stream, root, str(tmp_path / "ck"), CRISP, available_now=False, processing_time="1 second", timeout_seconds=45)
    assert 44 < time.monotonic() - began < 90 and not query.isActive
    store = run.RunStore(spark, root, data.frame(spark, items[:1]).schema["incident_id"].dataType, False)
    # The newest interval is parked; all before it were stepped through.
    assert sorted(r["interval_id"] for r in store.metrics().collect()) == sorted(GAPS)[:-1]
    kept = store.progress().collect()
    assert len(kept) == len(GAPS) and all(r["scheduling_ms"] is not None for r in kept)
    # A run to the end closes what was left open.
    run.run_stream(stream, root, str(tmp_path / "ck"), CRISP)
    check(final(store), simulate(items, CRISP))


def test_a_replay_that_goes_on_stages_only_what_is_new(spark, tmp_path, monkeypatch):
    from roadpulse.plans import replay as plan

    paths = []
    monkeypatch.setattr(plan, "scratch_path", lambda _, name: paths.append(str(tmp_path / f"{name}{len(paths)}")) or paths[-1])
    items = history(60)
    df = data.frame(spark, items)
    # An interval may have any number, the largest too.
    top = df.filter(df.interval_id == GAPS[-1]).selectExpr("* except (interval_id)", "2147483647 as interval_id")
    store = replay(df.filter("interval_id <= 2"), str(tmp_path / "r"), CRISP)
    replay(df, str(tmp_path / "r"), CRISP)
    check(final(store), simulate(items, CRISP))
    replay(df, str(tmp_path / "r"), CRISP)
    good = [sorted(p.name for p in Path(d).glob("is_good=true/at=*")) for d in paths]
    assert good == [["at=1", "at=2"], [f"at={t}" for t in GAPS if t > 2], []]
    wide = replay(df.unionByName(top), str(tmp_path / "wide"), CRISP)
    assert {r["interval_id"] for r in wide.metrics().collect()} == {*GAPS, 2147483647}


@pytest.mark.parametrize("per_trigger", [1, 3, None])
def test_an_interval_may_come_in_many_files_and_batches(spark, tmp_path, per_trigger):
    items = history(60)
    feed = tmp_path / "feed"
    feed.mkdir()
    for k in range(3):
        for t in GAPS:
            rows = [x for x in items if x["t"] == t][k::3]
            folder = feed / f"interval_id={t}"
            folder.mkdir(exist_ok=True)
            lines = [f"{x['id']},{x['lat']},{x['lon']},{x['bearing']},x,{x['road']}" for x in rows]
            lines += ["7,north,1,1,x,m1"]
            path = folder / f"part-{k}.txt"
            path.write_text("\n".join(lines) + "\n")
            os.utime(path, (1_700_000_000 + 10 * t + k,) * 2)
    (feed / "other.txt").write_text("8,52.0,-1.0,40,x,m1\n")
    stream = src.stream_incident_csv(spark, str(feed), per_trigger)
    root = str(tmp_path / "r")
    run.run_stream(stream, root, str(tmp_path / "ck"), CRISP)
    store = run.RunStore(spark, root, data.frame(spark, items[:1]).schema["incident_id"].dataType, False)
    check(final(store), simulate(items, CRISP))
    assert {r["interval_id"]: r["n_incidents"] for r in store.metrics().collect()} == dict.fromkeys(GAPS, 60)
    assert store.read_aside("late") is None
    bad = [(r["interval_id"], r["bad_reason"]) for r in store.read_aside("quarantine").collect()]
    assert sorted(bad, key=str) == sorted([(None, "interval")] + [(t, "latitude") for t in GAPS] * 3, key=str)


def test_nothing_is_left_in_the_scratch_folder(spark, tmp_path, monkeypatch):
    from roadpulse.session import checkpoint_root

    def tables():
        return set(os.listdir(checkpoint_root(spark).removeprefix("file:")))

    before, items = tables(), history(60)
    small = dataclasses.replace(CRISP, max_group_rows=15)  # slices and blocks
    store = replay(data.frame(spark, items), str(tmp_path / "r"), small)
    assert tables() == before
    check(final(store), simulate(items, CRISP))
    # Nor by a step that fails.
    monkeypatch.setattr(run.IntervalRunner, "_measure", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        replay(data.frame(spark, items), str(tmp_path / "f"), small)
    assert tables() == before


def test_replay_sets_aside_what_cannot_take_part(spark, tmp_path):
    items = history(60)
    df = data.frame(spark, items)
    bad = df.limit(7).withColumn("interval_id", df.interval_id.cast("int") * None)
    store = replay(df.unionByName(bad), str(tmp_path / "r"), CRISP, last_interval=2)
    got = store.read_aside("quarantine")
    assert [(r[0], r[1]) for r in got.select("interval_id", "bad_reason").collect()] == [(None, "interval")] * 7
    early = df.limit(4).selectExpr("* except (interval_id)", "0 as interval_id")
    replay(df.unionByName(early), str(tmp_path / "r"), CRISP)
    check(final(store), simulate(items, CRISP))
    assert store.read_aside("late").count() == 4


def test_batches_without_a_commit_are_not_seen(spark, tmp_path):
    items = history(60)
    store = replay(data.frame(spark, items), str(tmp_path / "r"), CRISP, last_interval=1)
    before = store.outcomes().count(), store.metrics().count()
    store.write_outcome(store.read_outcome(store.latest()), 99, 99)
    assert (store.outcomes().count(), store.metrics().count()) == before
    assert store.latest().batch_id == 1


def test_quantiles_of_small_states(spark, tmp_path):
    df = data.frame(spark, data.rows(30, 5))
    for name, threshold in (("some", 1.2), ("none", 1e9)):
        p = FuzzyParams(radius_miles=3.0, init_miles=1.0, delete_threshold=threshold, hotspot_threshold=threshold)
        row = replay(df, str(tmp_path / name), p).metrics().first()
        assert len(row["fv_quantiles"]) == len(row["sd_quantiles"]) == 6
        assert (row["fv_quantiles"] == [None] * 6) == (name == "none")


def test_ages_count_intervals(spark, tmp_path):
    items = history(60)
    store = replay(data.frame(spark, items), str(tmp_path / "r"), CRISP)
    for r in final(store).collect():
        assert r["age"] == GAPS[-1] - r["created_interval"] + 1


def test_step_without_incidents_or_state(spark):
    empty = data.frame(spark, data.rows(3, 1)).filter("false")
    state = data.hotspots(spark, data.rows(12, 2)).selectExpr(
        "* except (sd)", "0 as created_interval", "0 as last_interval"
    )
    got = interval_step(empty, state, CRISP, 1)
    assert got.n_incidents == 0
    assert {r["hs_id"]: r["fitness"] for r in got.outcome.collect()} == {
        r["hs_id"]: pytest.approx(r["fitness"] * 0.7) for r in state.collect()
    }
    assert interval_step(empty, state.filter("false"), CRISP, 1).outcome.count() == 0


@pytest.mark.parametrize("bad", [{"decay_rate": 1.0}, {"radius_miles": 0}, {"pick": "any"}, {"seed_percent": 101}])
def test_parameter_ranges(bad):
    with pytest.raises(ValueError):
        CrispParams(**bad)
    with pytest.raises(ValueError):
        FuzzyParams(conf_threshold=0)


def test_staged_and_parked_incidents_lie_in_small_files(spark, monkeypatch, tmp_path):
    """Otherwise a step over many incidents of one interval is left to few tasks."""
    from pyspark.sql import types as T

    from roadpulse.streaming import run, store

    for module in (run, store):
        monkeypatch.setattr(module, "FILE_ROWS", 10)
    rows = data.frame(spark, data.rows(95, 51)).coalesce(1)
    staged, ids = run.stage_by_interval(rows)
    kept = store.RunStore(spark, str(tmp_path), T.LongType(), False)
    kept.park(rows, 0, 1)
    for got in (staged, kept.read_parked([(0, 1)])):
        assert ids == [1] and len(got.inputFiles()) >= 10
        assert {r[0] for r in got.select("incident_id").collect()} == set(range(95)) and got.count() == 95


def test_replayed_incidents_lie_in_small_files(spark, monkeypatch, tmp_path):
    from roadpulse.plans import replay as plan

    monkeypatch.setattr(plan, "FILE_ROWS", 10)
    seen = []

    def note(self, batch, batch_id, ids):
        seen.append((len(batch.inputFiles()), batch.count(), ids))

    monkeypatch.setattr(run.IntervalRunner, "run_batch", note)
    plan.replay(data.frame(spark, data.rows(95, 52)).coalesce(1), str(tmp_path / "run"), CRISP)
    assert [s[1:] for s in seen] == [(95, [1])] and seen[0][0] >= 10
