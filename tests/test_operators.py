"""Merging, upsert, rules, groups and splits on hand-made rows; invariance under partitioning and repetition."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from dieframe.functions import columns as C
from dieframe.operators import joins as J
from dieframe.operators import merge as M
from dieframe.operators import report as P
from dieframe.operators import rules as R
from dieframe.operators import sources as O
from dieframe.operators import stats as S
from dieframe.plans import base as B
from dieframe.plans import measurements  # noqa: F401  (registers its queries)
from dieframe.sources import schema as SC
from dieframe.sources import tables as T
from dieframe.streaming import load as L
from dieframe.streaming.days import run_days

LONG = "lot string, wafer string, x int, y int, temp double, step string, seq string, site int, ts timestamp_ntz, line string, item string, value double"
T0 = dt.datetime(2026, 8, 4, 9)


def row(item, value, seq="1", ts=T0, **other):
    base = dict(lot="PA100", wafer="01", x=3, y=4, temp=25.0, step="M2", seq=seq, site=9, ts=ts, line="L1", item=item, value=value) | other
    return tuple(base.values())


def long(spark, *rows):
    return spark.createDataFrame(list(rows), LONG)


def values(df):
    return {r.item: r.value for r in df.collect()}


def merged(df):
    return M.merge_seq(M.merge_retest(df))


def test_merge(spark):
    day = dt.timedelta(days=1)
    assert values(merged(long(spark, row("Vt", 0.1), row("Ioff", 1.0, "2")))) == {"Vt": 0.1, "Ioff": 1.0}
    assert values(merged(long(spark, row("Vt", 0.1), row("Vt", 0.2, ts=T0 + day), row("Vt", None, ts=T0 + 2 * day)))) == {"Vt": 0.2}
    both = merged(long(spark, row("Vt", 1.0), row("Vt", 3.0, "2")))
    assert values(both) == {"Vt": 2.0} and [tuple(r) for r in M.averaged_cells(both).collect()] == [("Vt", 1)]
    assert values(merged(long(spark, row("Vt", 1.0, ts=None), row("Vt", 5.0, ts=None), row("Gm", 2.0, ts=None), row("Gm", 1.0)))) == {"Vt": 5.0, "Gm": 1.0}
    assert merged(long(spark, row("Vt", 1.0), row("Vt", 1.0, x=4), row("Vt", 1.0, step="M3"), row("Vt", 1.0, temp=85.0), row("Vt", 1.0, site=5), row("Vt", 1.0, temp=None))).count() == 6
    assert merged(long(spark, row("Vt", None)).where("false")).count() == 0


def test_upsert(spark):
    day2, before = T0 + dt.timedelta(days=1), T0 - dt.timedelta(days=1)
    s = M.store(long(spark, row("Vt", 0.10), row("Ioff", 1.0)))
    s = M.upsert(s, M.store(long(spark, row("Vt", 0.90, ts=day2), row("Gm", 5.0, ts=day2))))
    s = M.upsert(s, M.store(long(spark, row("Vt", 0.50, ts=before), row("Ron", 7.0, ts=before))))
    assert values(s) == {"Vt": 0.90, "Ioff": 1.0, "Gm": 5.0, "Ron": 7.0} and {r.ts for r in s.collect()} == {day2}
    again = M.upsert(s, s)
    assert sorted(map(str, again.select(*sorted(s.columns)).collect())) == sorted(map(str, s.select(*sorted(s.columns)).collect()))
    assert M.new_points(s, s).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_change_nothing(spark, parts):
    rows = [row(f"i{k % 5}", float(k % 7), str(k % 3), T0 + dt.timedelta(hours=k % 11), x=k % 4) for k in range(300)]
    want = sorted(map(str, merged(long(spark, *rows)).collect()))
    assert sorted(map(str, merged(long(spark, *reversed(rows)).repartition(parts)).collect())) == want


def test_stream_equals_one_load(spark, tmp_path):
    rows = [row(f"i{k % 5}", float(k % 7), str(k % 3), T0 + dt.timedelta(hours=k), x=k % 4) for k in range(60)]
    for k in range(3):
        long(spark, *rows[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    store = L.Store(spark, str(tmp_path / "store"), buckets=4)
    L.stream_into(str(tmp_path / "in"), schema, store, lambda d: d)
    assert store.table().count() == 20 and store.table().groupBy("key").count().count() == 4
    assert sorted(r.rows for r in store.log().collect()) == [20, 20, 20]
    L.stream_into(str(tmp_path / "in"), schema, store, lambda d: d)  # nothing new
    assert store.log().count() == 3


def test_a_lost_load_goes_on_in_a_new_store(spark, tmp_path):
    """The second batch is lost behind its data and its log; a store opened later reads the first state, and loads the rest once."""
    folder, root = str(tmp_path / "in"), str(tmp_path / "store")
    rows = [row(f"i{k % 3}", float(k), "1", T0 + dt.timedelta(hours=k), x=k % 4) for k in range(40)]
    long(spark, *rows[:20]).coalesce(1).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    L.stream_into(folder, schema, L.Store(spark, root), lambda d: d)
    first = sorted(map(str, L.Store(spark, root).table().collect()))
    long(spark, *rows[20:]).coalesce(1).write.mode("append").parquet(folder)

    class Lost(L.Store):
        def _note(self, rows):
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        L.stream_into(folder, schema, Lost(spark, root), lambda d: d)
    again = L.Store(spark, root)
    assert sorted(map(str, again.table().collect())) == first and again.log().count() == 1
    L.stream_into(folder, schema, again, lambda d: d)
    whole = L.Store(spark, str(tmp_path / "other"))
    assert whole.load(long(spark, *rows), "all") == dict.fromkeys(L.COUNTS, 0) | {"rows_in": 40, "points_new": 4, "cells": 12, "rows_out": 12}
    assert whole.load(long(spark, *rows), "all") is None
    assert sorted(map(str, again.table().collect())) == sorted(map(str, whole.table().collect())) and again.log().count() == 2


def test_another_note_beside_an_old_store_skips_nothing(spark, tmp_path):
    """The stream's own note is lost, and files came since: the old ones are not loaded again, the new ones are."""
    folder, root = str(tmp_path / "in"), str(tmp_path / "store")
    long(spark, row("a", 1.0), row("a", 2.0, x=1)).coalesce(1).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    L.stream_into(folder, schema, L.Store(spark, root), lambda d: d)
    long(spark, row("b", 3.0)).coalesce(1).write.mode("append").parquet(folder)
    (tmp_path / "store" / "checkpoint").rename(tmp_path / "gone")
    store = L.Store(spark, root)
    L.stream_into(folder, schema, store, lambda d: d, files=10)  # old and new in one batch
    assert sorted(r.rows for r in store.log().collect()) == [1, 2] and store.versions().select("batch").distinct().count() == 2
    assert sorted((r.x, r.item, r.value) for r in store.table().collect()) == [(1, "a", 2.0), (3, "a", 1.0), (3, "b", 3.0)]


def test_counts_of_a_load(spark, tmp_path):
    store, day2 = L.Store(spark, str(tmp_path / "s")), T0 + dt.timedelta(days=1)
    first = store.load(long(spark, row("Vt", 0.4), row("Vt", 0.6, "2"), row("Ioff", 1.0), row("Off", None), row("Vt", 0.1, x=9)), "1")
    assert first == dict.fromkeys(L.COUNTS, 0) | {"rows_in": 5, "rows_empty": 1, "cells": 3, "averaged": 1, "rows_out": 3, "points_new": 2}
    assert [tuple(r) for r in M.averaged_cells(M.store(long(spark, row("Vt", 0.4), row("Vt", 0.6, "2")), counted=True)).collect()] == [("Vt", 1)]
    again = store.load(long(spark, row("Vt", 0.5), row("Vt", 0.1, x=9)), "2")
    assert (again["points_updated"], again["points_changed"], again["cells_filled"], again["cells_replaced"]) == (2, 0, 0, 0)
    late = store.load(long(spark, row("Vt", 0.9, ts=day2), row("Gm", 5.0, ts=day2), row("Vt", 0.3, x=10)), "3")
    assert (late["points_new"], late["points_updated"], late["points_changed"], late["cells_filled"], late["cells_replaced"]) == (1, 1, 1, 1, 1)
    assert store.load(long(spark, row("Off", None, x=50)), "4")["rows_empty"] == 1 and store.load(long(spark, row("Off", None, x=50)), "4") is None
    assert store.table().count() == 5 and {r.ts for r in store.table().where("x = 3").collect()} == {day2}


def test_buckets_follow_the_first_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_ROWS", 10)
    store = L.Store(spark, str(tmp_path / "s"), batches=100)
    store.load(long(spark, row("a", 1.0), row("b", 1.0), row("c", 1.0)), "1")
    assert {r.buckets for r in store.versions().collect()} == {30}
    L.Store(spark, str(tmp_path / "s"), buckets=5).load(long(spark, row("a", 2.0, lot="q")), "2")  # settled by the first load
    assert {r.buckets for r in store.versions().collect()} == {30} and store.table().count() == 4


def test_the_batch_is_scanned_once(spark, tmp_path):
    long(spark, row("a", 1.0)).write.parquet(str(tmp_path / "t"))
    plan = M.store(spark.read.parquet(str(tmp_path / "t")), counted=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_days_go_on_after_a_crash(spark, tmp_path):
    """Five days with data, the third is lost: the first two stay, the next run loads the rest, one more does nothing, a day with new rows is merged again."""
    days = [dt.datetime(2026, 8, d, 9) for d in (1, 3, 4, 5, 7)]
    rows = [row(f"i{k % 3}", float(k), "1", days[k % 5] + dt.timedelta(minutes=k), x=k % 4) for k in range(60)]
    path, root = str(tmp_path / "t"), str(tmp_path / "s")
    T.lay_out(long(spark, *rows), path)

    class Lost(L.Store):
        def _note(self, noted):
            if noted.where("batch LIKE '%2026-08-04%'").count():
                raise RuntimeError("lost")
            super()._note(noted)

    job = lambda store, n=30, **of: run_days(spark.read.parquet(path), store, "L1", n, dt.date(2026, 8, 7), **of)
    first = job(Lost(spark, root))
    assert first.code == 1 and [*first.loaded] == [dt.date(2026, 8, 1), dt.date(2026, 8, 3)] and "lost" in first.problem
    store = L.Store(spark, root)
    second = job(store)
    assert second.code == 0 and len(second.skipped) == 2 and len(second.loaded) == 3 and second.total()["rows_in"] == 36
    third = job(store)
    assert third.code == 0 and len(third.skipped) == 5 and not third.loaded and "5 there already" in third.summary()
    whole = L.Store(spark, str(tmp_path / "w"))
    whole.load(long(spark, *rows), "all")
    assert sorted(map(str, store.table().collect())) == sorted(map(str, whole.table().collect()))
    T.lay_out(long(spark, row("late", 1.0, ts=days[4])), str(tmp_path / "more"))
    spark.read.parquet(str(tmp_path / "more")).write.mode("append").partitionBy("day").parquet(path)
    assert [*job(store, 3).loaded] == [dt.date(2026, 8, 7)]
    assert job(store, 1, items=["nothing"]).code == 1 and job(store, 0).code == 2 and run_days(spark.read.parquet(path), store, "", 1).code == 2


def test_a_job_from_the_command_line(spark, tmp_path, capsys):
    T.lay_out(long(spark, row("a", 1.0, temp=23.9)), str(tmp_path / "t"))
    from dieframe import job

    assert job.main([str(tmp_path / "t"), str(tmp_path / "s"), "--line", "L1", "--days", "2", "--today", "2026-08-05"]) == 0
    assert "1 days loaded" in capsys.readouterr().out
    assert L.Store(spark, str(tmp_path / "s")).table().first().temp == 25.0
    assert job.main([str(tmp_path / "t"), str(tmp_path / "s"), "--line", "L9", "--today", "2026-08-05"]) == 1


def test_windows_read_their_own_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [row("a", float(k), ts=T0 + dt.timedelta(days=k)) for k in range(30)] + [row("a", 0.5, ts=None)]
    T.lay_out(long(spark, *rows), path)
    laid = spark.read.parquet(path)
    assert laid.count() == 31 and laid.select(*long(spark, rows[0]).columns).exceptAll(long(spark, *rows)).count() == 0
    window = T.extract(laid, "L1", "2026-08-06", "2026-08-08")
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and sorted(r.value for r in window.collect()) == [2.0, 3.0, 4.0]
    assert len(window.inputFiles()) == 3 or window._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    days = T.laid_days(spark, path)
    assert [r.day for r in days.orderBy("day").collect()] == [(T0 + dt.timedelta(days=k)).date() for k in range(30)]
    assert "content" not in days._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    T.lay_out(long(spark, *rows), path + "m", unit="month")
    window = T.extract(spark.read.parquet(path + "m"), "L1", "2026-08-30", "2026-09-01")
    assert "PartitionFilters: [isnotnull(month" in window._jdf.queryExecution().executedPlan().toString() and sorted(r.value for r in window.collect()) == [26.0, 27.0, 28.0]
    assert [r.day for r in T.probe_days(laid.where("value > 27"), "ts").collect()] == [dt.date(2026, 9, 1), dt.date(2026, 9, 2)]


def test_normalize(spark):
    df = spark.createDataFrame([("L", "7", "x", "1.0", "2026-01-02 03:04:05", "23.9", "e", "1.5")], "ROOT_LOT_ID string, ` wafer_id ` string, chip_x_pos string, step_seq string, tkout_time string, temperature string, extra string, et_value string")
    out = SC.normalize(df)
    assert out.columns == [*SC.LONG.names, "extra"]
    r = out.first()
    assert (r.root_lot_id, r.wafer_id, r.chip_x_pos, r.step_seq, r.tkout_time, r.temperature, r.et_value, r.part_id, r.extra) == ("L", "7", None, "1", dt.datetime(2026, 1, 2, 3, 4, 5), 25.0, 1.5, None, "e")
    assert {tuple(x) for x in SC.emptied_keys(df, out).collect()} == {("total_site_cnt", "absent")}
    twice = spark.createDataFrame([(None, "b")], "`Item_Id` string, item_id string")
    spark.conf.set("spark.sql.caseSensitive", True)
    try:
        assert SC.norm_columns(twice).first().item_id == "b"
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_rules_in_order():
    sheet = [{"category": "REAL", "alias": "A"}, {"category": "ADDP", "alias": "C", "formula": "{B}*2"}, {"category": "ADDP", "alias": "B", "formula": "{A}+1"}, {"category": "ADDP", "alias": "X", "formula": "{Y}"}, {"category": "ADDP", "alias": "Y", "formula": "{X}"}, {"category": "ADDP", "alias": "Z", "formula": "{Q}"}, {"category": "ADDP", "alias": "E", "formula": ""}]
    ready, notes = R.validate(sheet)
    assert [r["alias"] for r in ready] == ["A", "B", "C"] and len(notes) == 4


def test_std_group(spark):
    rows = [("l", "w", "s", q, 5, 25.0, a, b) for q, a, b in [("1", 1.0, 5.0), ("1", 3.0, None), ("2", 4.0, None), (None, 1.0, 2.0), (None, 3.0, None)]]
    df = spark.createDataFrame(rows, "lot string, wafer string, step string, seq string, site int, temp double, A double, B double")
    got = {(r.seq, r.A): r.s for r in R.std_group(df, "Std({A}, {B}, {A})", "s").collect()}
    assert got["1", 1.0] == pytest.approx(2.0) and got["1", 3.0] == pytest.approx(2.0) and got["2", 4.0] is None and got[None, 1.0] == pytest.approx(1.0)
    assert R.std_group(df.drop("seq"), "Std({A}, {B})", "s").where("s IS NULL").count() == 3


def test_exclusions(spark):
    log = spark.createDataFrame([("a", "r", None, dt.date(2026, 1, 1), "manual")], "key string, reason string, item string, at date, kind string")
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    two = J.exclude(log, keys, "tukey", F.lit("2026-02-01").cast("date"), "filter")
    assert two.count() == 3 and J.include(two, kind="filter").count() == 1 and J.include(two, keys.where("key = 'a'")).count() == 1


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    assert J.null_safe(a, a.withColumnRenamed("v", "w"), ["k"]).where("w IS NULL").count() == 0


def test_resolve_lot(spark):
    lots = spark.createDataFrame([("PA100",), ("PA200",), ("pb1",)], "lot string")
    typed = spark.createDataFrame([("PA100",), ("pa200",), ("B1",), ("PA",), ("ZZ",)], "typed string")
    got = {}
    for r in J.resolve_lot(typed, lots).collect():
        got.setdefault(r.typed, []).append((r.lot, r.how))
    assert got["PA100"] == [("PA100", "exact")] and got["pa200"] == [("PA200", "case")] and got["B1"] == [("pb1", "part")]
    assert {h for _, h in got["PA"]} == {"similar"} and len(got["ZZ"]) == 3


def test_resolve_lot_equals_all_pairs(spark):
    """Against every pair compared, with common beginnings, typing errors anywhere, other lengths, and nothing in common."""
    r = random.Random(6)
    stored = [f"PA{k:04}" for k in range(0, 400, 3)] + [f"pb{k}.1" for k in range(20)] + ["Q", "zz9", "PA0001X"]
    typed = [r.choice(stored) for _ in range(10)]
    for t in [r.choice(stored) for _ in range(25)]:
        k = r.randrange(len(t))
        typed += [t[:k] + r.choice("xQ7") + t[k + 1 :], t[:k] + t[k + 1 :] or "y"]
    typed += ["", "0", "PA", "!!!!", "PA012", "A0000", "pA0003"]
    got = {}
    for x in J.resolve_lot(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(t,) for t in stored], "lot string")).collect():
        got.setdefault(x.typed, set()).add((x.lot, x.how))
    for t in typed:
        low = t.lower()
        case = sorted(s for s in stored if s.lower() == low)
        inside = [s for s in stored if low and low in s.lower()]
        near = sorted(stored, key=lambda s: (-sum(a == b for a, b in zip(low, s.lower())), s))[:5]
        want = {(t, "exact")} if t in stored else {(case[0], "case")} if case else {(inside[0], "part")} if len(inside) == 1 else {(s, "similar") for s in near}
        assert got[t] == want, t


def test_few_candidates_of_lots_with_one_beginning(spark):
    """10,000 lots that all begin alike, 40 typed with an error: a few hundred pairs each instead of 10,000."""
    r = random.Random(7)
    lots = spark.range(10_000).selectExpr("concat('PA', lpad(cast(id AS string), 4, '0'), 'K') AS lot").selectExpr("lot", "lower(lot) AS low")
    wrong = set()
    while len(wrong) < 40:
        t = f"pa{r.randrange(10_000):04}k"
        k = r.randrange(2, 6)
        wrong.add(t[:k] + "x" + t[k + 1 :])
    typed = spark.createDataFrame([(t, t) for t in wrong], "typed string, own string")
    assert J.near_lots(typed, lots).count() <= 40 * 300


def test_few_candidates_of_lots_with_running_numbers(spark):
    """40 typed with another beginning than all 10,000 stored lots: tens of pairs each, where the digits alone are shared with thousands."""
    lots = spark.range(10_000).selectExpr("concat('PA', id) AS lot").selectExpr("lot", "lower(lot) AS low")
    typed = spark.range(1000, 9000, 200).selectExpr("concat('qx', id) AS typed").selectExpr("typed", "typed AS own")
    assert J.near_lots(typed, lots).count() <= 40 * 100


def test_running_numbers_without_one_task(spark):
    rows = [(k, k % 7, k % 3) for k in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int, n int")
    out = P.running(df, [F.col("b").desc(), F.col("a").asc()], "before", F.col("n"))
    want, total = {}, 0
    for a, b, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[a] = total
        total += n
    assert {r.a: r.before for r in out.collect()} == want
    ranks = P.ranked(df, F.col("a").asc(), name="place")
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert {r.a: r.place for r in ranks.collect()} == {k: k + 1 for k in range(500)}
    assert plan.count("SinglePartition") == 1 and "_sum" in plan.split("SinglePartition")[1].split("Scan")[0]  # under it: the ranges' sums
    assert P.running(df.where("false"), [F.col("a").asc()], "x").count() == 0


def test_smallest_values_stay_few(spark):
    df = spark.createDataFrame([(f"v{k % 50:02}", None, T0) for k in range(300)], "line string, part string, ts timestamp_ntz")
    out = S.lot_context(df, most=3).first()
    assert (out.line, out.part, out.first) == (["v00", "v01", "v02"], [], T0.date())
    assert "TakeOrderedAndProject" in S.smallest(df, "line", 3)._jdf.queryExecution().executedPlan().toString()


def test_dropped_and_applied_rows_are_counted(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, -1.0), ("B", 1, 2.0), (None, 1, -3.0)], "step string, site int, v double")
    seen = Observation()
    J.by_condition(df, step="A", seen=seen).write.parquet(str(tmp_path / "a"))
    assert seen.get == {"kept": 1, "dropped": 2}
    seen = Observation()
    once = R.reapply_absolute(df, ["v", "gone"], seen)
    once.write.parquet(str(tmp_path / "b"))
    assert seen.get == {"applied": 1, "turned": 2} and [r.v for r in spark.read.parquet(str(tmp_path / "b")).orderBy("v").collect()] == [1.0, 2.0, 3.0]


def test_split_gains(spark):
    r = random.Random(3)
    rows = [(f, float(r.randrange(8)), r.gauss(0, 1)) for f in "ab" for _ in range(60)] + [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("d", None, 1.0)]
    got = {x.factor: (x.gain, x.n) for x in O.split_gains(spark.createDataFrame(rows, "factor string, x double, y double")).collect()}
    square = lambda v: sum((a - sum(v) / len(v)) ** 2 for a in v) if v else 0.0
    for f in "ab":
        mine = [(x, y) for g, x, y in rows if g == f]
        cuts = [square([y for x, y in mine if x <= c]) + square([y for x, y in mine if x > c]) for c in range(7)]
        assert got[f] == (pytest.approx(1 - min(cuts) / square([y for _, y in mine])), 60)
    assert got["c"] == (0.0, 2) and "d" not in got


def test_headings_of_split_sheets(spark):
    long = spark.createDataFrame([("l", "1", "A", "x"), ("l", "2", "A", " ")], "`ROOT_LOT_ID` string, ` Wafer_ID` string, step_id string, Condition string")
    assert sorted((r.lot, r.wafer, r.A) for r in O.split_load(long, ["A"]).collect()) == [("l", "1", "x"), ("l", "2", "x")]
    wide = spark.createDataFrame([("l", "1", "x")], "lot string, wafer_id string, code string")
    assert O.split_load(wide, ["code"]).columns == ["lot", "wafer", "code"]
    with pytest.raises(ValueError):
        O.split_headers(wide.drop("lot"))


def test_trends_with_points_and_corners(spark):
    df = spark.createDataFrame([("g", "l", "1", "a", 1.0), ("g", "l", "1", "a", 3.0), ("g", "m", "1", "a", 6.0), ("g", "l", "1", "b", 9.0)], "gid string, lot string, wafer string, item string, value double")
    at = spark.createDataFrame([("a", 5.0), ("b", None)], "item string, x double")
    out = S.trend_points(df, at, F.avg("value"), F.avg("value"), spark.createDataFrame([("a", 4.0), ("b", 1.0)], "item string, target double"), points=True)
    got = sorted((r.kind, str(r.lot), r.value) for r in out.collect())
    assert got == [("group", "None", 4.0), ("lot", "l", 2.0), ("lot", "m", 6.0), ("strip", "l", 1.0), ("strip", "l", 3.0), ("strip", "m", 6.0), ("target", "None", 4.0)]
    assert R.corners_of(spark.createDataFrame([("a", 1.0, float("nan"))], "item string, ff double, SS double"), "functional").collect() == [("a", "FF", 1.0)]
    assert R.corners_of(at, "functional").count() == 0 == R.corners_of(at, "other").count()


def test_raw_passes_meet_hash_aggregates_only(spark, tmp_path):
    t = spark.createDataFrame([("l", "1", "s", "p", "r", T0)], "lot string, wafer string, step string, ppid string, reticle string, ts timestamp_ntz")
    t.write.parquet(str(tmp_path / "t"))
    plan = O.track_condition(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    nodes = [line for line in plan.splitlines() if "Aggregate" in line]
    assert "HashAggregate" in nodes[-1] and "HashAggregate" in nodes[-2]  # what stands on the scan, before and behind the first shuffle


def test_tracking(spark):
    t = spark.createDataFrame([("l", "1", "s1", "p", None, 1), ("l", "1", "s1", None, "r", 2), ("l", "2", "s1", "q", None, 1), ("l", "3", "s1", "q", None, 1), ("l", "1", "s2", "u", None, 1), ("l", "2", "s2", "u", None, 1), ("l", "3", "s10", "", "", 1)], "lot string, wafer string, step string, ppid string, reticle string, ts int")
    c = O.track_condition(t)
    assert {(r.wafer, r.step): r.condition for r in c.collect()}["1", "s1"] == "r"
    assert [r.step for r in O.track_split_steps(c).collect()] == ["s1"]
    assert {r.wafer: r.s1 for r in O.track_matrix(c, ["s1"]).collect()} == {"1": "r", "2": "q", "3": "q"}
    assert {r.step: r.baseline for r in O.majority(c, ["step"]).collect()} == {"s1": "q", "s2": "u"}


def test_split(spark):
    s = spark.createDataFrame([("l", "1", "A", "B"), ("l", "2", " ", "B"), ("l", "3", "A", "C"), ("l", "4", "D", "B")], "lot string, wafer string, M1 string, M2 string")
    w = O.split_load(s.withColumn("M1", F.when(F.trim("M1") != "", F.col("M1"))), ["M1", "M2"])
    assert {r.wafer: r.M1 for r in w.collect()}["2"] == "A"
    combos = {(r.M1, r.M2): (r.gid, r.wafers, r.is_ref) for r in O.split_combos(w, ["M1", "M2"], {"M1": "A", "M2": "B"}).collect()}
    assert combos == {("A", "B"): ("x0", 2, True), ("A", "C"): ("x1", 1, False), ("D", "B"): ("x2", 1, False)}
    assert [tuple(r) for r in O.split_confounds(w, ["M1"], ["M2"]).collect()] == [("A", "M2", ["B", "C"])]


def test_vote_factors(spark):
    import random

    r = random.Random(0)
    rows = [("l1" if k < 24 else "l2", str(k), (c := r.uniform(10, 20)) + (50 if k >= 24 else 0), r.gauss(5, 1), (c - 15) ** 2 * 0.01 + r.gauss(0, 0.005), None) for k in range(48)]
    df = spark.createDataFrame(rows, "lot string, wafer string, CD double, THK double, Vt double, GONE double")
    top = O.vote_factors(df, "Vt", ["CD", "THK", "GONE"]).collect()
    assert top[0].factor == "CD" and len(top) == 2
    assert O.vote_factors(df.limit(5), "Vt", ["CD"]).count() == 0


def test_tukey(spark):
    rows = [("a", f"k{i}", float(i)) for i in range(20)] + [("a", "far", 500.0)] + [("b", f"k{i}", float(i * i * i)) for i in range(6)]
    df = spark.createDataFrame(rows, "item string, key string, value double")
    for interp in ("linear", "nearest"):
        b = S.tukey_bounds(df, interp=interp)
        assert [tuple(r) for r in S.tukey_flag(df, b, ["a", "b"]).collect()] == [("far", "a")]
        assert b.where("item = 'b'").first().lo is None


def test_pages_and_order(spark):
    w = spark.createDataFrame([(f"L{a}", f"W{b}") for a in (2, 10) for b in range(1, 26)], "lot string, wafer string")
    pages = {(r.lot, r.wafer): r.page for r in P.pages(w).collect()}
    assert pages["L2", "W1"] == 1 and pages["L2", "W13"] == 2 and pages["L2", "W25"] == 3 and pages["L10", "W1"] == 4
    assert [r.lot for r in P.column_order(w).orderBy("place").collect()][:26] == ["L2"] * 25 + ["L10"]


def test_item_range(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 1.0), ("c", 100.0), ("c", -1.0)], "item string, value double")
    specs = spark.createDataFrame([("a", 0.0, None)], "item string, lsl double, usl double")
    got = {r.item: (r.lo, r.hi) for r in S.item_range(df, specs, ["c"]).collect()}
    assert got["a"] == pytest.approx((-0.3, 3.3)) and got["b"] == pytest.approx((4.5, 5.5)) and got["c"] == pytest.approx((10**-0.2, 10**2.2))


def test_flags_keys_and_globs(spark):
    cells = ["TRUE", "t", "y", "1", "1.00", "O", "FALSE", "0.0", "x", "", None, "YES", "NO", "2", "maybe"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(C.rule_flag("c")).collect()]
    assert got == [True] * 6 + [False] * 5 + [None] * 4
    keys = spark.createDataFrame([(None, "a"), ("~", "a"), ("a|b", "c"), ("a", "b|c"), ("", "a"), ("\\~", "a")], "p string, q string")
    assert keys.select(C.key_hash("p", "q")).distinct().count() == 6
    items = spark.createDataFrame([("VTH_1",), ("ron",)], "item string")
    assert J.by_globs(items, []).count() == 0 and J.by_globs(items, [], ["ron"]).count() == 1 and J.by_globs(items, ["vth*"]).count() == 1


def test_attached_rows_existed(spark):
    df = spark.createDataFrame([("a", "1")], "lot string, wafer string")
    other = spark.createDataFrame([("a", "1", "a", "z"), ("a", "01", "b", "y"), ("A", "W1", None, "x")], "lot string, wafer string, p string, q string")
    assert [(r.p, r.q) for r in J.attach(df, other, True).collect()] == [("a", "z")]


def test_base_lot_is_the_lowest_as_text(spark):
    rows = [(lot, "1", f"{lot}{k}", "s", 25.0, 9, f"i{k}", 1.0) for lot in ("PA2", "PA1", "PA10") for k in range(2)]
    df = spark.createDataFrame([*rows, ("PA0", "1", "q", "s", 25.0, 9, "i0", 1.0)], "lot string, wafer string, key string, step string, temp double, site int, item string, value double")
    out = {r.lot: r for r in S.coverage_lots(df).collect()}
    assert {r.base_lot for r in out.values()} == {"PA1"} and out["PA0"].missing_items == ["i1"] and out["PA2"].missing_items == []


def test_flagged_item_follows_the_list(spark):
    df = spark.createDataFrame([("k", "b", 9.0), ("k", "a", 9.0), ("k", "c", 9.0)], "key string, item string, value double")
    bounds = spark.createDataFrame([(i, 0.0, 1.0, 20) for i in "abc"], "item string, lo double, hi double, n int")
    assert [r.item for r in S.tukey_flag(df, bounds, ["c", "b"]).collect()] == ["c"]
    assert [r.item for r in S.tukey_flag(df.where("item IN ('a', 'b')"), bounds, ["c", "b"]).collect()] == ["b"]


@pytest.mark.parametrize("interp", ["linear", "nearest"])
@pytest.mark.parametrize("sure", [20, 10_000])
def test_quantiles_are_exact_in_brackets(spark, monkeypatch, interp, sure):
    """With a coarse sketch, so that groups of more than 20 values are bracketed."""
    monkeypatch.setattr(S, "SURE", sure)
    r = random.Random(1)
    rows = [(g, float(r.choice([r.randrange(9), r.gauss(0, 5)]))) for g, n in (("a", 700), ("b", 19), ("c", 1), (None, 200)) for _ in range(n)] + [("a", None), ("d", None)]
    out = S.quantiles(spark.createDataFrame(rows, "g string, value double").repartition(5), {"x": 0.25, "y": 0.5, "z": 0.9}, ("g",), interp).collect()
    assert sorted(str(r.g) for r in out) == ["None", "a", "b", "c"]
    for row_ in out:
        v = sorted(x for g, x in rows if g == row_.g and x is not None)
        assert row_.n == len(v)
        for name, q in (("x", 0.25), ("y", 0.5), ("z", 0.9)):
            at = (len(v) - 1) * q
            want = v[int(at + 0.5)] if interp == "nearest" else v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))
            assert abs(row_[name] - want) < 1e-9


def test_working_set_is_used_again(spark, tmp_path):
    long(spark, row("a", 1.0, "1", T0), row("b", 2.0, "1", T0)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    lots = [df.first().lot]
    one, two = (T.materialize(df, lots, ["a"], str(tmp_path / "w")) for _ in range(2))
    assert one.inputFiles() == two.inputFiles() and two.count() == 1
    assert T.materialize(df, lots, ["b"], str(tmp_path / "w")).inputFiles() != one.inputFiles()
    assert T.preview(df, T.SNIPPETS["item list"]).count() == 2
    assert T.materialize(df.where("value > 0"), lots, ["a"], str(tmp_path / "w")).inputFiles() != one.inputFiles()
    name = Path(df.inputFiles()[0].removeprefix("file://"))
    long(spark, row("a", 7.0, "1", T0), row("b", 2.0, "1", T0)).coalesce(1).write.parquet(str(tmp_path / "u"))
    name.with_name(f".{name.name}.crc").unlink()
    next((tmp_path / "u").glob("*.parquet")).rename(name)  # the same name, other rows
    new = T.materialize(spark.read.parquet(str(tmp_path / "t")), lots, ["a"], str(tmp_path / "w"))
    assert new.inputFiles() != one.inputFiles() and 7.0 in {r.value for r in new.collect()}


def test_no_sort_aggregate_for_retests(spark):
    plan = M.merge_retest(long(spark, row("a", 1.0, "1", T0)))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_pasted_pairs(spark):
    text = "STEP_ID\titem_id\r\nA\tCD 1\tmore\n ; B ;THK;\nalone\n\nA,CD 1"
    assert sorted(map(tuple, O.wanted_pairs(spark, text).collect())) == [("A", "CD 1"), ("B", "THK")]
    assert O.wanted_pairs(spark, "").count() == 0


def test_metrology_query_reads_all_days(spark):
    sf = "/root/testdata/sf0.001"
    every = B.metrology(spark, sf).where("lot IN ('3', '7') AND (item LIKE 'S%' OR item LIKE '%MO%')")
    assert every.where("ts < '1994-01-01' OR ts >= '1996-01-01'").count() > 0
    assert B.QUERIES["src_metrology"](spark, sf).count() == every.count()


def test_retests_are_merged_without_tables_of_hashes(spark):
    """One sort that can spill, then the two aggregates over sequences; six tables of hashes in a task took 1.5 GB for 42 MB of shuffled rows."""
    plan = M.merge_seq(M.merge_retest(long(spark, row("a", 1.0))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate(") == 2 and plan.count("Exchange") == 1


def test_first_load_keeps_and_shuffles_no_hashes(spark, tmp_path):
    store = L.Store(spark, str(tmp_path / "s"), buckets=2)
    first = store.load(long(spark, row("a", 1.0), row("b", 2.0), row("a", 3.0, lot="q"), row("b", None, lot="r")), "1")
    assert "key" not in spark.read.parquet(str(tmp_path / "s" / "batches")).columns
    assert (first["points_new"], first["points_updated"], first["points_changed"], first["rows_out"]) == (2, 0, 0, 3)
    second = store.load(long(spark, row("a", 4.0, ts=T0 + dt.timedelta(1)), row("a", 5.0, lot="z")), "2")
    assert (second["points_new"], second["points_updated"], second["points_changed"], second["cells_replaced"]) == (1, 1, 1, 1)
    keys = {r.key for r in M.store(long(spark, row("a", 1.0), row("a", 3.0, lot="q"), row("a", 5.0, lot="z"))).collect()}
    assert {r.key for r in store.table().collect()} == keys


def test_rows_of_one_group_meet_its_bounds_in_many_tasks(spark):
    rows = spark.range(2000).selectExpr("'a' AS item", "cast(id AS double) AS value").unionByName(spark.sql("SELECT cast(NULL AS string) AS item, 1D AS value"))
    bounds = spark.createDataFrame([("a", 10.0, 1000.0, 2000), (None, 0.0, 1.0, 1)], "item string, lo double, hi double, n long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(before, ("-1", "false")):
            spark.conf.set(c, v)
        met = S.join_bounds(rows, bounds)
        assert met.count() == 2000 and met.select(F.spark_partition_id()).distinct().count() == 3
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_medians_are_filled_from_one_pass(spark, tmp_path):
    spark.createDataFrame([(1.0,), (None,), (3.0,), (8.0,)], "v double").write.parquet(str(tmp_path / "source"))
    out = P.median_fill(spark.read.parquet(str(tmp_path / "source")), ["v"])
    assert not any("/source/" in f for f in out.inputFiles()) and sorted(r.v for r in out.collect()) == [1.0, 3.0, 3.0, 8.0]
