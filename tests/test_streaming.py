"""Machines alone, batch runs, and streams that must give the same rows."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from wayfold.streaming import machines as M
from wayfold.streaming import operators as L


def run(machine, events):
    out = [r for e in events for r in machine.feed(e)]
    return out + list(machine.close())


def test_a_busy_page_still_fires_every_three_seconds():
    fired = run(M.Bursts(), [{"ts_ms": t, "trigger": "dom-change", "route": "/a"} for t in range(0, 10_000, 500)])
    assert [(r[0], r[1]) for r in fired][:2] == [(0, 3000), (3000, 6000)] and len(fired) == 4


def test_a_new_route_gets_its_own_settle_time():
    events = [{"ts_ms": t, "trigger": "dom-change", "route": "/a" if t < 2500 else "/b"} for t in range(0, 5000, 500)]
    assert run(M.Bursts(), events)[0][1] == 5400


def test_first_real_trigger_names_the_burst():
    r = run(M.Bursts(), [{"ts_ms": t, "trigger": n, "route": "/"} for t, n in ((0, "dom-change"), (100, "dom-change"), (200, "click:Pay"), (300, "click:No"))])
    assert r == [(0, 1200, "click:Pay", 200, 4, "dom-change (x2),click:Pay,click:No")]


def test_rate_cap_delays_but_loses_nothing():
    events = [{"ts_ms": t, "trigger": n, "route": "/"} for t, n in ((0, "a"), (1000, "b"), (2600, "c"))]
    assert [(r[1], r[4]) for r in run(M.Bursts(state_gap=2000), events)] == [(900, 1), (3500, 2)]
    assert [(r[1], r[2]) for r in run(M.Bursts(state_gap=2000), [events[0], {"ts_ms": 1000, "trigger": "manual", "route": "/"}])] == [(900, "a"), (1900, "manual")]


def test_breaker_window_starts_at_the_first_record():
    events = [{"ts_ms": t, "trigger": "dom-change", "records": 300} for t in (0, 900, 1500, 12_000)]
    assert [r[2] for r in run(M.VolumeBreaker(), events)] == [True, False, False, True]


def test_menu_memory_shows_what_is_gone():
    out = run(M.MenuMemory(), [{"ts_ms": 1, "state_id": "s1", "item": "a"}, {"ts_ms": 1, "state_id": "s1", "item": "b"}, {"ts_ms": 2, "state_id": "s2", "item": "b"}])
    assert out == [("s1", "a", True), ("s1", "b", True), ("s2", "b", True), ("s2", "a", False)]


def test_machines_keep_all_rows():
    seen = [{"ts_ms": 1, "state_id": "s1", "item": f"i{k}"} for k in range(1500)] + [{"ts_ms": 2, "state_id": "s2", "item": "x"}]
    assert [sum(o[0] == s for o in run(M.MenuMemory(), seen)) for s in ("s1", "s2")] == [1500, 1501]
    assert [sum(o[0] == s for o in run(M.MenuMemory(1000, 300), seen)) for s in ("s1", "s2")] == [1500, 300]
    fast = [{"ts_ms": k, "trigger": f"t{k}", "route": "/"} for k in range(100)]
    assert [len(o[5].split(",")) for m in (M.Bursts(), M.Bursts(named=60)) for o in run(m, fast)] == [100, 60]


EVENTS = [("d1", t, "dom-change" if t % 1500 else "click:x", "/" if t < 9000 else "/b") for t in (*range(0, 6000, 500), 9000, 9100, 20000)] + [("d2", 5, "load", "/"), ("d2", 4000, "manual", "/")]


def batch(spark, rows=EVENTS):
    df = spark.createDataFrame(rows, "session string, ts_ms long, trigger string, route string")
    return df.withColumn("ts", F.timestamp_millis("ts_ms"))


def test_batch_bursts_do_not_depend_on_chunks(spark):
    got = [sorted(tuple(r) for r in L.bursts(batch(spark), by=["session"], chunk=c).collect()) for c in (1000, 10**9)]
    assert got[0] == got[1] and len(got[0]) >= 6


#: Streams start their watermark at the epoch, so test events lie well after it.
BASE = 1_000_000


def stream_rows(spark, tmp_path, df, build, name):
    """The rows of a stream over files of ``df``, plus later events that move the watermark on."""
    df = df.withColumn("ts_ms", F.col("ts_ms") + BASE).withColumn("ts", F.timestamp_millis("ts_ms"))
    src = str(tmp_path / name)
    df.orderBy("ts_ms").coalesce(1).write.json(src)
    far = df.select(*[F.lit("zz").alias(c) if c == "session" else F.lit(10**9).alias(c) if c == "ts_ms" else F.timestamp_millis(F.lit(10**9)).alias(c) if c == "ts" else F.col(c) for c in df.columns]).limit(1)
    for i in range(2):
        far.withColumn("ts_ms", F.col("ts_ms") + i * 100_000).withColumn("ts", F.timestamp_millis("ts_ms")).write.mode("append").json(src)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(src)
    q = build(s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).filter("session <> 'zz'").collect())


def test_stream_bursts_equal_batch(spark, tmp_path):
    df = batch(spark)
    want = sorted((r[0], r[1] + BASE, r[2] + BASE, r[3], r[4] + BASE, *r[5:]) for r in L.bursts(df, by=["session"]).collect())
    got = stream_rows(spark, tmp_path, df, lambda s: L.stream_bursts(s, by=["session"]), "bursts")
    assert got == want


def test_stream_states_keep_a_b_a(spark, tmp_path):
    df = spark.createDataFrame([("d", i * 10, f"s{i}", sig, "click", "/") for i, sig in enumerate("AABA")], "session string, ts_ms long, id string, signature string, trigger string, route string").withColumn("ts", F.timestamp_millis("ts_ms"))
    got = stream_rows(spark, tmp_path, df, lambda s: L.stream_transitions(s, by=["session"]), "states")
    assert [(r[2], r[5]) for r in got] == [("s0", None), ("s2", "s0"), ("s3", "s2")]


def test_stream_attribution_and_hints(spark, tmp_path):
    rows = [("d", 0, "a1", "mark"), ("d", 3000, "c1", "row"), ("d", 3500, "c2", "row"), ("d", 9000, "c3", "row")]
    df = spark.createDataFrame(rows, "session string, ts_ms long, id string, kind string").withColumn("ts", F.timestamp_millis("ts_ms"))
    got = stream_rows(spark, tmp_path, df, lambda s: L.stream_attribution(s, by=["session"]), "calls")
    assert [(r[2], r[3]) for r in got] == [("c1", "a1"), ("c2", "a1"), ("c3", None)]
    got = stream_rows(spark, tmp_path, df, lambda s: L.stream_hints(s, by=["session"]), "hinted")
    assert [(r[2], r[3]) for r in got] == [("c1", "a1"), ("c2", None), ("c3", None)]


def test_pause_gate_stream_equals_batch(spark, tmp_path):
    rows = [("d", 0, "a", "row"), ("d", 10, "p", "paused"), ("d", 20, "b", "row"), ("d", 30, "r", "resumed"), ("d", 40, "c", "row")]
    df = spark.createDataFrame(rows, "session string, ts_ms long, id string, kind string").withColumn("ts", F.timestamp_millis("ts_ms"))
    got = stream_rows(spark, tmp_path, df, lambda s: L.stream_pause_gate(s, by=["session"]), "gated")
    marks = df.filter("kind <> 'row'").select("session", F.col("kind").alias("type"), F.col("ts").alias("at"))
    want = L.pause_gate(df.filter("kind = 'row'"), marks, by=["session"], ts="ts").collect()
    assert [r[2] for r in got] == sorted(r.id for r in want) == ["a", "c"]


def test_download_patches_in_any_order(spark):
    rows = [("d1", 3.0, "patched", "complete", "", "A{3}.pdf", "pdf", 900), ("d1", 1.0, "created", "in_progress", "application/pdf", "", "", -1), ("d1", 2.0, "patched", "", "", "", "", 500), ("d2", 200.0, "created", "in_progress", "", "", "", -1)]
    df = spark.createDataFrame(rows, "id string, s double, kind string, state string, mime string, name_shape string, extension string, size_bytes long").withColumns({"at": F.timestamp_seconds("s"), "started_at": F.timestamp_seconds(F.lit(1.0))})
    r = L.download_lifecycle(df).collect()
    assert len(r) == 1 and (r[0].state, r[0].mime, r[0].extension, r[0].size_bytes) == ("complete", "application/pdf", "pdf", 900)


def test_late_rows_go_aside_also_after_a_restart(spark, tmp_path):
    src, good, late = str(tmp_path / "late"), [], []
    for times in ((100.0, 101.0), (50.0, 95.0, 120.0), (105.0, 111.0)):
        spark.createDataFrame([("d", t) for t in times], "session string, s double").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").json(src)
        s = spark.readStream.schema("session string, s double, ts timestamp").json(src)
        q = L.route_late(s, ts="ts", delay=timedelta(seconds=10), on_time=lambda d, e: good.extend(r.s for r in d.collect()), late=lambda d, e: late.extend(r.s for r in d.collect())).option("checkpointLocation", str(tmp_path / "lck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(late) == [50.0, 105.0] and sorted(good) == [95.0, 100.0, 101.0, 111.0, 120.0]


def test_rows_within_the_delay_change_nothing(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(f"d{rng.randint(0, 2)}", t * 37, f"r{t}", rng.choice(("mark", "row", "row"))) for t in range(120)]
    src = str(tmp_path / "shuffled")
    arrival = sorted(rows, key=lambda r: r[1] + rng.randint(0, 900))
    make = lambda part: spark.createDataFrame([(d, t + BASE, i, k) for d, t, i, k in part], "session string, ts_ms long, id string, kind string").withColumn("ts", F.timestamp_millis("ts_ms"))
    for at in range(0, len(arrival), 20):
        make(arrival[at : at + 20]).coalesce(1).write.mode("append").json(src)
    for i in (1, 2, 3):
        make([(d, 10**8 * i, "end", "row") for d in ("d0", "d1", "d2")]).coalesce(1).write.mode("append").json(src)
    s = spark.readStream.schema("session string, ts_ms long, id string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).json(src)
    q = L.stream_attribution(s, by=["session"], delay=timedelta(seconds=1)).writeStream.format("memory").queryName("shuffled").outputMode("append").option("checkpointLocation", str(tmp_path / "sck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want, last = [], {}
    for d, t, i, k in sorted(rows, key=lambda r: r[1]):
        if k == "mark":
            last[d] = (t, i)
        else:
            want.append((d, i, last[d][1] if d in last and t - last[d][0] <= M.ACTION_WINDOW else None))
    assert sorted((r[0], r[2], r[3]) for r in spark.table("shuffled").collect() if r[2] != "end") == sorted(want, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("gap", ["900 milliseconds"])
def test_session_window_gap(spark, gap):
    assert L.gap_sessions(batch(spark), by=["session"], ts="ts", gap=gap).count() >= 4
