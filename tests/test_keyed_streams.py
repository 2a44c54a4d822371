"""Keyed state: batches against one pass, and a restart from the checkpoint."""

import random

import pytest

from tidemark.streaming import keyed

EVENT = "run string, id long, fresh boolean, mark string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    return [(r.choice("abc"), k, r.random() < 0.2, r.choice(["m1", "m2", None])) for k in range(120)]


def live(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, at):
    """What the stream has given so far, over all its runs."""
    q = df.writeStream.format("parquet").option("path", f"{at}/{name}-out").option("checkpointLocation", f"{at}/{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, df.sparkSession.read.parquet(f"{at}/{name}-out").collect()), key=repr)


def test_state_goes_on_over_batches_and_restarts(spark, rows, tmp_path):
    keyed.use_rocksdb(spark)
    made = {"seq": lambda s: keyed.numbered(s, "run", "id").select("run", "id", "seq"), "stop": lambda s: keyed.saturated(s, "run", "id", "fresh", 5), "diff": lambda s: keyed.changes(s, "run", "id", "mark")}
    got = {}
    for part in (rows[:40], rows[40:80], rows[80:]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name, f in made.items():  # a new query each time, from the checkpoint of the last
            got[name] = drain(f(live(spark, f"{tmp_path}/in")), name, tmp_path)
    n, streak, last, want = {}, {}, {}, {"seq": [], "stop": {}, "diff": []}
    for run, k, fresh, mark in rows:
        n[run] = n.get(run, 0) + 1
        want["seq"].append((run, k, n[run]))
        streak[run] = 0 if fresh else streak.get(run, 0) + 1
        if streak[run] >= 5:
            want["stop"].setdefault(run, (run, k, 5))
        want["diff"].append((run, k, "unreachable" if mark is None else "new" if run not in last else "same" if last[run] == mark else "changed"))
        if mark is not None:
            last[run] = mark
    assert got["seq"] == sorted(want["seq"], key=repr)
    assert got["stop"] == sorted(want["stop"].values(), key=repr)
    assert got["diff"] == sorted(want["diff"], key=repr)
