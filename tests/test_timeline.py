"""Ordered operators against plain Python, with and without hot borrowers."""

import pytest
from pyspark.sql import functions as F

from dueday.operators import assemble, labels, timeline
from dueday.operators.skew import hot_keys, lookup
from dueday.schemas import EVENT_ORDER, HISTORY_FEATURES
from frames import EVENT_SCHEMA, POS_SCHEMA, event, random_events

NAMES = [c.split()[0] for c in EVENT_SCHEMA.split(",")]


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA).repartition(5)


def brute_history(rows, some=1):
    """History features by walking each borrower's events one by one; for every event or for one in ``some``."""
    out = {}
    by = {}
    for r in (dict(zip(NAMES, r)) for r in rows):
        by.setdefault(r["SK_ID_CURR"], []).append(r)
    for b, events in by.items():
        events.sort(key=lambda e: [e[c] for c in EVENT_ORDER])
        seen = []
        for i, e in enumerate(events):
            if i % some:
                seen.append(e)
                continue
            late = [int((x["aggregated_payment_delay_days"] or 0) > 0) for x in seen]
            on = [int(not l and not x["missing_payment_flag"]) for l, x in zip(late, seen)]
            delay = [x["aggregated_payment_delay_days"] or 0 for x in seen]

            def run(flags):
                n = 0
                for f in reversed(flags):
                    if not f:
                        break
                    n += 1
                return n

            last = seen[-1] if seen else None
            out[f"{b}_{i}"] = {
                "hist_total_installments": i,
                "hist_late_count": sum(late),
                "hist_missed_count": sum(x["missing_payment_flag"] for x in seen),
                "hist_partial_count": sum(x["underpaid_after_aggregation_flag"] for x in seen),
                "hist_on_time_count": sum(on),
                "hist_delay_mean": sum(delay) / i if i else None,
                "hist_delay_max": max(delay) if delay else None,
                "hist_recent_delay": last["aggregated_payment_delay_days"] if last else None,
                "hist_recent_payment_ratio": (
                    last["total_amount_paid"] / last["AMT_INSTALMENT"] if last and last["AMT_INSTALMENT"] else None
                ),
                "hist_delay_mean_last_3": sum(delay[-3:]) / 3,
                "hist_delay_mean_last_6": sum(delay[-6:]) / 6,
                "hist_late_count_last_3": sum(late[-3:]),
                "hist_late_count_last_6": sum(late[-6:]),
                "hist_on_time_streak": run(on),
                "hist_late_streak": run(late),
            }
            seen.append(e)
    return out


@pytest.mark.parametrize("limit", [10**6, 30, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_brute_force(spark, many_parts, seed, limit):
    rows = random_events(seed)
    got = {
        r.snapshot_id: r.asDict() for r in timeline.installment_history(frame(spark, rows), limit=limit).collect()
    }
    want = brute_history(rows)
    assert got.keys() == want.keys()
    for key, features in want.items():
        for name in HISTORY_FEATURES:
            value = got[key][name]
            assert value == (pytest.approx(features[name]) if features[name] is not None else None), (key, name)


def test_one_day_and_number_is_cut_into_bounded_runs(spark, many_parts):
    """50,000 events of one borrower on one day and number, and some before and after."""
    rows = [event(1, k, 5, -50, delay=(k * 7) % 40 - 5, missing=int(k % 11 == 0), version=1 + k % 2) for k in range(50_000)]
    rows += [event(1, 90_000 + k, k, -60 + k, delay=k % 3) for k in range(9)] + [event(1, 90_100, 6, -50), event(1, 90_200, 1, -20), event(2, 1, 1, -50)]
    events = frame(spark, rows)
    hot = hot_keys(events, "SK_ID_CURR", 1000)
    assert hot.count == 1
    cut = timeline.split_hot(events, hot)
    sizes = [r["count"] for r in cut.groupBy("SK_ID_CURR", *timeline.PIECE).count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == len(rows)
    got = {r.snapshot_id: r.asDict() for r in timeline.installment_history(events, hot).collect()}
    want = brute_history(rows, some=97)
    assert len(got) == len(rows)
    for key, features in want.items():
        for name in HISTORY_FEATURES:
            value = got[key][name]
            assert value == (pytest.approx(features[name]) if features[name] is not None else None), (key, name)


@pytest.mark.parametrize("limit", [10**6, 30, 1])
def test_labels_do_not_depend_on_hot_borrowers(spark, many_parts, limit):
    rows = random_events(7)
    events = frame(spark, rows)
    pos = spark.createDataFrame([(0, -1, 45, 0), (0, 0, 0, 31), (1, -2, 10, None), (2, -3, 90, 0)], POS_SCHEMA)
    hot = hot_keys(events, "SK_ID_CURR", limit)
    snaps = timeline.build_snapshots(events, hot)
    by = {}
    for r in (dict(zip(NAMES, r)) for r in rows):
        by.setdefault(r["SK_ID_CURR"], []).append(r)
    pos_days = {0: [-30, 0], 1: [], 2: [-90], 3: []}
    want, nexts = {}, {}
    for b, es in by.items():
        es.sort(key=lambda e: [e[c] for c in EVENT_ORDER])
        top = max(e["DAYS_INSTALMENT"] for e in es)
        bad = [e["DAYS_INSTALMENT"] for e in es if (e["aggregated_payment_delay_days"] or 0) >= 30]
        for i, e in enumerate(es):
            t = e["DAYS_INSTALMENT"]
            if i + 1 < len(es):
                n = es[i + 1]
                nexts[f"{b}_{i}"] = int(
                    n["missing_payment_flag"] or n["underpaid_after_aggregation_flag"]
                    or (n["aggregated_payment_delay_days"] or 0) > 0
                )
            if top >= t + 20:
                want[f"{b}_{i}"] = int(any(t < d <= t + 20 for d in bad + pos_days[b]))
    wide = timeline.build_snapshots(events, hot, window_days=20)
    got = {r.snapshot_id: r.future_dpd30 for r in labels.future_dpd30(wide, pos, 20, hot=hot).collect()}
    assert got == want
    missed = {r.snapshot_id: r.missed_upcoming_emi for r in labels.missed_upcoming_emi(snaps).collect()}
    assert missed == nexts


def test_first_row_of_a_borrower_has_no_history(spark):
    rows = [event(b, b, k, -100 + k, delay=9, under=1) for b in (1, 2) for k in range(1, 5)]
    first = timeline.installment_history(frame(spark, rows)).where("snapshot_id = '2_0'").first()
    assert first.hist_late_count == first.hist_partial_count == first.hist_late_streak == 0
    assert first.hist_delay_mean is None and first.hist_delay_max is None
    assert first.hist_delay_mean_last_3 == 0.0


def test_rolling_mean_divides_by_the_window_length(spark):
    rows = [event(1, 1, k, -100 + k, delay=6) for k in range(1, 4)]
    got = timeline.installment_history(frame(spark, rows)).orderBy("borrower_event_order").collect()
    assert [r.hist_delay_mean_last_3 for r in got] == [0.0, 2.0, 4.0]


def test_loan_id_breaks_ties(spark):
    rows = [event(1, loan, 1, -50) for loan in (30, 10, 20)]
    got = timeline.build_snapshots(frame(spark, rows)).orderBy("borrower_event_order").collect()
    assert [r.SK_ID_PREV for r in got] == [10, 20, 30]


@pytest.mark.parametrize("ahead, hit", [(0, 0), (1, 1), (90, 1), (91, 0)])
def test_window_is_open_at_the_snapshot_and_closed_at_its_end(spark, ahead, hit):
    rows = [event(1, 1, 1, -300), event(1, 1, 2, -300 + ahead, delay=30), event(1, 1, 3, -100)]
    no_pos = spark.createDataFrame([], POS_SCHEMA)
    snaps = timeline.build_snapshots(frame(spark, rows))
    assert labels.future_dpd30(snaps, no_pos).where("snapshot_id = '1_0'").first().future_dpd30 == hit


def test_incomplete_windows_are_left_out(spark):
    rows = [event(1, 1, 1, -100), event(1, 1, 2, -11), event(1, 1, 3, -10)]
    no_pos = spark.createDataFrame([], POS_SCHEMA)
    got = labels.future_dpd30(timeline.build_snapshots(frame(spark, rows)), no_pos).collect()
    assert [r.snapshot_id for r in got] == ["1_0"]


def test_interval_exists_equals_brute_force(spark):
    rows = [(b, d) for b in range(3) for d in range(0, 60, 7)]
    marks = [(0, 5), (0, 5), (1, 21), (2, 59)]
    left = spark.createDataFrame(rows, "SK_ID_CURR bigint, snapshot_day int")
    right = spark.createDataFrame(marks, "SK_ID_CURR bigint, snapshot_day int")
    got = {(r.SK_ID_CURR, r.snapshot_day): r.exists for r in assemble.interval_exists(left, right, 10).collect()}
    assert got == {(b, d): int(any(b == m and d < x <= d + 10 for m, x in marks)) for b, d in rows}


def test_lookup_spreads_a_hot_key(spark, many_parts):
    left = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).where("k % 3 <> 0")
    plain = sorted(left.join(right, "k", "left").collect())
    hot = hot_keys(left, "k", 100)
    assert [tuple(r) for r in hot.frame.collect()] == [(1, 9)]
    spread = lookup(left, right, "k", ["id"], hot)
    assert sorted(spread.select("k", "id", "v").collect()) == plain
    assert hot_keys(left, "k", 1000).count == 0


def test_hot_and_missing_keys_are_counted_exactly(spark, many_parts):
    rows = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, -5).when(F.col("id") % 30 == 1, None).when(F.col("id") % 30 == 2, -6).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(rows, "k", 1000)
    assert sorted(map(tuple, hot.frame.collect())) == [(-6, 10), (-5, 100)] and hot.null_pieces == 10
    assert hot_keys(rows.where("k >= 0"), "k", 1000).count == 0
    assert hot_keys(rows.limit(0), "k", 1000).count == 0


@pytest.mark.parametrize("limit", [10**6, 3])
def test_model_table_does_not_depend_on_hot_borrowers(spark, data, limit):
    some = data.events.where("SK_ID_CURR % 10 < 3")
    few = data.entity.where("SK_ID_CURR % 10 < 3")
    base = assemble.model_table(some, data.pos, few, limit=10**6).collect()
    again = assemble.model_table(some, data.pos, few, limit=limit).collect()
    assert sorted(map(str, base)) == sorted(map(str, again))


def test_result_does_not_depend_on_partitions(spark, data):
    def rows():
        return sorted(map(str, data.history.where("SK_ID_CURR < 40").collect()))

    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("limit", [10**6, 2])
def test_an_event_must_name_its_borrower(spark, limit):
    rows = [event(1, k, k, -k) for k in range(1, 9)] + [event(None, 99, 1, -5)]
    with pytest.raises(Exception, match="an event has no SK_ID_CURR"):
        timeline.installment_history(frame(spark, rows), limit=limit).collect()
