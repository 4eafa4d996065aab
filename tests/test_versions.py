"""Tables that change together: replacement, failure between tables, rivals, compaction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strideframe.sources.versions import Store


def _tables(spark, sessions, sets, pulses):
    return {
        "sessions": spark.createDataFrame(sessions, "user_id int, day int, session int"),
        "sets": spark.createDataFrame(sets, "user_id int, day int, session int, reps int"),
        "pulses": spark.createDataFrame(pulses, "user_id int, day int, bpm int"),
    }


def _all(store):
    return {t: sorted(map(tuple, store.read(t).collect()), key=str) for t in ("sessions", "sets", "pulses")}


def test_user_days_are_replaced_in_all_tables_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        store.read("sessions")
    assert store.replace(_tables(spark, [(1, 1, 10), (1, 2, 11), (2, 1, 12), (None, 1, 13)], [(1, 1, 10, 5), (2, 1, 12, 6)], [(1, 1, 80), (1, 2, 81), (2, 1, 82)])) == 1
    change = _tables(spark, [(1, 1, 20), (3, 1, 21)], [], [(1, 1, 90), (1, 1, 90)])
    want = {"sessions": sorted([(1, 1, 20), (3, 1, 21), (1, 2, 11), (2, 1, 12), (None, 1, 13)], key=str), "sets": [(2, 1, 12, 6)], "pulses": sorted([(1, 1, 90), (1, 1, 90), (1, 2, 81), (2, 1, 82)], key=str)}
    for version in (2, 3):  # a second run changes nothing
        assert store.replace(change) == version and _all(store) == want
    assert store.compact(["sessions", "sets", "pulses"]) == 4 and _all(store) == want and len(store.segments()) == 1
    assert store.replace(_tables(spark, [(None, 1, 99)], [], [])) == 5 and (None, 1, 99) in _all(store)["sessions"] and (None, 1, 13) not in _all(store)["sessions"]


def test_a_failure_between_tables_leaves_the_old_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.replace(_tables(spark, [(1, 1, 10)], [(1, 1, 10, 5)], [(1, 1, 80)]))
    before = _all(store)
    broken = _tables(spark, [(1, 1, 20)], [(1, 1, 20, 9)], [(1, 1, 0)])
    broken["pulses"] = broken["pulses"].withColumn("bpm", F.raise_error(F.lit("no more")).cast("int"))
    with pytest.raises(Exception, match="no more"):
        store.replace(broken)
    assert _all(store) == before and store.replace(_tables(spark, [(1, 1, 20)], [], [])) == 2


def test_two_writers_do_not_take_the_same_number(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.replace(_tables(spark, [(1, 1, 10)], [], []))
    with pytest.raises(FileExistsError):
        store._publish(1, [])
    assert len(store.segments()) == 1
