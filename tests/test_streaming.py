"""Partial summaries and the ingestion ledger: replays, restarts, compaction, and two runs at once."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from rostra.streaming import arrivals


def rows(spark, n):
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")).alias("kind"), (F.col("id") % 4).alias("who"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def wanted(df, keys, where=None):
    return tuples((df if where is None else df.where(where)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("s")))


@pytest.mark.parametrize("compact", [1, 2, 3, 100])
def test_partial_summaries_equal_the_batch(spark, tmp_path, compact):
    df, path = rows(spark, 60), f"file://{tmp_path}/s"
    made = lambda: arrivals.RunningSummary(path, ["kind", "who"], {"s": "v"}, compact)
    assert made().result(spark, df.schema).count() == 0
    for b in range(6):
        part = df.where(F.col("id") % 6 == b)
        made()(part, b)
        made()(part, b)  # given again, after a restart
        so_far = df.where(F.col("id") % 6 <= b)
        assert tuples(made().result(spark, df.schema)) == wanted(so_far, ["kind", "who"])
    assert tuples(made().result(spark, df.schema, ["who"], F.col("kind") == "1")) == wanted(df, ["who"], F.col("kind") == "1")
    left = sorted(p.name for p in (tmp_path / "s").iterdir())
    assert len(left) <= (7 if compact > 6 else compact)  # old tables go


def test_a_compaction_that_broke_off_is_made_anew(spark, tmp_path):
    df = rows(spark, 40)
    s = arrivals.RunningSummary(f"file://{tmp_path}/s", ["who"], {"s": "v"}, 2)
    s(df.where("id < 20"), 0)
    (tmp_path / "s/upto1").mkdir()  # begun, never finished
    s(df.where("id >= 20"), 1)
    assert tuples(s.result(spark, df.schema)) == wanted(df, ["who"])
    (tmp_path / "s/v0").mkdir()  # deletion broke off
    (tmp_path / "s/v0/_SUCCESS").touch()
    assert tuples(s.result(spark, df.schema)) == wanted(df, ["who"])


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    df = rows(spark, 50)
    source, check = f"file://{tmp_path}/in", f"file://{tmp_path}/check"
    for part in (df.where("id < 30"), df.where("id >= 30")):
        part.repartition(3).write.mode("append").parquet(source)
        s = arrivals.RunningSummary(f"file://{tmp_path}/s", ["kind"], {"s": "v"}, 2)
        arrivals.arriving(spark, source, df.schema).writeStream.foreachBatch(s).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert tuples(s.result(spark, df.schema)) == wanted(df, ["kind"])


def test_top_k_keeps_two_tables(spark, tmp_path):
    best = arrivals.RunningTopK(f"file://{tmp_path}/top", [F.desc("v")], "id", 3)
    for n in range(6):
        best(spark.createDataFrame([(n, n)], "id int, v int"), n)
    assert sorted(p.name for p in (tmp_path / "top").iterdir()) == ["v4", "v5"]


def links(spark, *keys):
    return spark.createDataFrame([(k, f"title {k}") for k in keys], "key string, title string")


def test_ledger_of_runs(spark, tmp_path):
    ledger = arrivals.IngestionLedger(spark, f"file://{tmp_path}/l", most_tries=3)
    state = lambda: {r.key: (r.status, r.tries) for r in arrivals.IngestionLedger(spark, ledger.path).state().collect()}
    seen = []

    def work(status):
        def run(due):
            seen.append(sorted(r.key for r in due.collect()))
            return due.select("key", F.try_element_at(F.from_json(F.lit(status), "map<string,string>"), F.col("key")).alias("status"))

        return run

    assert ledger.run(links(spark, "a", "b", "b", "c", None), work('{"a": "done", "b": "needs_review"}')) == 2  # c failed
    assert state() == {"a": ("done", 1), "b": ("needs_review", 1)}
    assert ledger.run(links(spark, "a", "b", "c", "d"), work('{"b": "needs_review", "c": "done", "d": "done"}')) == 3
    assert ledger.run(links(spark, "a", "b"), work('{"b": "needs_review"}')) == 1
    assert ledger.run(links(spark, "a", "b", "c", "d"), work("{}")) == 0  # b was tried three times: nothing is due
    assert state() == {"a": ("done", 1), "b": ("needs_review", 3), "c": ("done", 1), "d": ("done", 1)}
    assert seen == [["a", "b", "c"], ["b", "c", "d"], ["b"]]
    with pytest.raises(Exception, match="lost"):
        ledger.run(links(spark, "z"), lambda due: (_ for _ in ()).throw(RuntimeError("lost")))
    assert "z" not in state() and ledger.run(links(spark, "z"), lambda due: due.select("key", F.lit("done").alias("status"))) == 1  # the lock was given back


def test_two_runs_at_once(spark, tmp_path):
    path, inside, go = f"file://{tmp_path}/l", threading.Event(), threading.Event()

    def slow(due):
        inside.set()
        assert go.wait(60)
        return due.select("key", F.lit("done").alias("status"))

    got = []
    first = threading.Thread(target=lambda: got.append(arrivals.IngestionLedger(spark, path).run(links(spark, "a"), slow)))
    first.start()
    assert inside.wait(60)
    assert arrivals.IngestionLedger(spark, path).run(links(spark, "a"), slow) is None  # the other works
    go.set()
    first.join(60)
    assert got == [1] and arrivals.IngestionLedger(spark, path).run(links(spark, "a"), slow) == 0


def test_locks_of_lost_runs_are_broken(spark, tmp_path):
    held = arrivals.RunLock(spark, f"file://{tmp_path}/k/lock")
    with held, pytest.raises(arrivals.Locked), arrivals.RunLock(spark, f"file://{tmp_path}/k/lock"):
        pass
    (tmp_path / "k/lock").touch()
    with arrivals.RunLock(spark, f"file://{tmp_path}/k/lock", stale_s=-5):
        assert (tmp_path / "k/lock").exists()
    assert not (tmp_path / "k/lock").exists()


def test_ledger_over_a_stream(spark, tmp_path):
    ledger = arrivals.IngestionLedger(spark, f"file://{tmp_path}/l")
    for keys in (("a", "b"), ("b", "c")):
        links(spark, *keys).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    done = ledger.on_batch(lambda due: due.select("key", F.lit("done").alias("status")))
    arrivals.arriving(spark, f"file://{tmp_path}/in", "key string, title string").writeStream.foreachBatch(done).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r.key: r.tries for r in ledger.state().collect()} == {"a": 1, "b": 1, "c": 1}
