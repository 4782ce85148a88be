import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.operators import codec, folds, models
from strandlog.operators.windows import numbered
from strandlog.sources.adopt import adopt, check_adopted, plan_adoption

ROWS = "sequence bigint, transaction_id bigint, key string, n bigint"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-5, 5)), min_size=1, max_size=30), st.integers(0, 30))
def test_forms_agree(spark, events, cut):
    rows = [(k + 1, (k // 3) + 1, key, n) for k, (key, n) in enumerate(events)]
    df = spark.createDataFrame(rows, ROWS)
    expected = {}
    for _, _, key, n in rows:
        expected[key] = expected.get(key, 0) * 2 + n
    ordered = {r["key"]: r["state"] for r in folds.fold_ordered(df, ["key"], F.col("n"), F.lit(0).cast("long"), lambda s, n: s * 2 + n).collect()}
    python = {r["key"]: r["v"] for r in folds.fold_python(df, "key", lambda: 0, lambda s, e: s * 2 + int(e["n"]), lambda s: {"v": s}, "key string, v bigint").collect()}
    assert ordered == python == expected
    state = lambda d: folds.fold_algebraic(d, [F.col("key")], n=F.sum("n"), last=F.max_by("n", "sequence"), sequence=F.max("sequence"))
    merged = models.keyed(state(df.where(F.col("sequence") <= cut)), state(df.where(F.col("sequence") > cut)), ["key"], ["n"], {"last": "sequence"})
    assert sorted(map(tuple, merged.select("key", "n", "last", "sequence").collect())) == sorted(map(tuple, state(df).select("key", "n", "last", "sequence").collect()))


def test_python_fold_keeps_failures_to_their_key(spark):
    df = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "b", 0), (3, 1, "a", 2), (4, 1, "b", 1)], ROWS)
    out = folds.fold_python(df, "key", lambda: 0, lambda s, e: s + 1 // e["n"], lambda s: {"v": s}, "key string, v bigint, failed_sequence bigint, failed_error string", on_error="keep")
    assert {r["key"]: r["failed_sequence"] for r in out.collect()} == {"a": None, "b": 2}


def test_numbered(spark):
    df = spark.range(1000).withColumn("x", F.hash("id"))
    got = [r["n"] for r in numbered(df, [F.col("x"), F.col("id")], "n").orderBy("x", "id").collect()]
    assert got == list(range(1, 1001))


def test_changes(spark):
    before = spark.createDataFrame([("a", 1), ("b", 5), ("c", 7)], "key string, n bigint")
    after = spark.createDataFrame([("a", 6), ("b", 6), ("c", 2), ("d", 1)], "key string, n bigint")
    got = {r["key"]: r["change"] for r in models.enter_leave(before, after, "key", F.col("n") >= 5).collect()}
    assert got == {"a": "entered", "b": "changed", "c": "left"}
    assert models.where_equal(after, {"n": 6}).count() == 2 and models.where_equal(after, {"n": "6"}).count() == 0


def test_codec():
    from datetime import UTC, datetime

    state = {"a": [1, 2.5, None, True], "m": {1: "x", ("t", 2): {3}}, "big": 2**70, "d": datetime(2020, 1, 1, tzinfo=UTC), "inf": float("inf")}
    assert codec.loads(codec.dumps(state)) == state and codec.estimate_size(state) > 0
    try:
        codec.dumps({"a": [object()]})
    except Exception as e:
        assert "$.a[0]" in str(e)
    assert codec.fingerprint(test_codec) == codec.fingerprint(test_codec)


def test_adoption(spark):
    old = spark.createDataFrame([(1, "A", json.dumps({"aId": "x", "k": "v"})), (2, "B", json.dumps({"bId": "y"}))], "id int, eventtype string, payload string")
    plan = plan_adoption(old)
    assert plan.renames == {"id": "sequence", "eventtype": "event_type"} and not plan.problems and plan.added == ["recorded_at", "transaction_id", "metadata"]
    log = adopt(old, ("k",), plan)
    check_adopted(old, "id", log)
    assert [tuple(r) for r in log.df.select("sequence", "event_id", "scope_k").orderBy("sequence").collect()] == [(1, "x", "v"), (2, "y", None)]
    assert plan_adoption(old.drop("payload")).problems == ["no column for payload"]
