"""Debounce by rule, over a table, and over a stream."""

import datetime as dt
import shutil
import subprocess
import sys

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.sources.events import FolderReader, changes
from lodestone.streaming import debounce

START = dt.datetime(2024, 1, 1)
EVENT = "event_type string, file_path string, dest_path string, is_directory boolean, ts timestamp"


def at(s):
    return START + dt.timedelta(seconds=s)


def events(spark, *rows):
    return spark.createDataFrame([(k, p, d, False, at(s)) for k, p, d, s in rows], EVENT)


def test_leading_edge():
    kept, last = debounce.accepted([pd.Timestamp(at(s)) for s in (0, 1.5, 2.5, 4.6)], ["modified"] * 4, pd.Timedelta(seconds=2))
    assert kept == [True, False, True, True] and last == pd.Timestamp(at(4.6))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["modified", "deleted"])), max_size=20), st.integers(1, 9))
def test_accepted_changes_are_apart(rows, pause):
    rows.sort()
    kept, _ = debounce.accepted([pd.Timestamp(at(s)) for s, _ in rows], [k for _, k in rows], pd.Timedelta(seconds=pause))
    assert all(ok for ok, (_, k) in zip(kept, rows, strict=True) if k == "deleted")
    times = [s for ok, (s, k) in zip(kept, rows, strict=True) if ok and k != "deleted"]
    assert all(b - a >= pause for a, b in zip(times, times[1:], strict=False))
    for ok, (s, k) in zip(kept, rows, strict=True):
        assert ok or any(0 <= s - t < pause for t in times)


def test_filters(spark):
    e = events(spark, ("created", "/r/__pycache__/a.py", None, 0), ("created", "/r/a.txtx", None, 0), ("deleted", "/r/__pycache__/a.py", None, 1), ("moved", "/r/a.py", "/r/b.py", 2), ("moved", "/r/a.py", "/r/node_modules/b.py", 3), ("moved", "/r/c.py", "/r/c.bin", 4))
    got = sorted((r.event_type, r.file_path, r.ts.second) for r in debounce.passing(e).collect())
    assert got == [("created", "/r/b.py", 2), ("deleted", "/r/__pycache__/a.py", 1), ("deleted", "/r/a.py", 2), ("deleted", "/r/a.py", 3)]


def test_table(spark):
    rows = [("modified", f"/r/{p}.py", None, s) for p in "ab" for s in (0, 1.5, 2.5, 4.6)]
    got = sorted((r.file_path, (r.ts - START).total_seconds()) for r in debounce.debounce(debounce.passing(events(spark, *rows)), 2000).collect())
    assert got == [(f"/r/{p}.py", s) for p in "ab" for s in (0.0, 2.5, 4.6)]
    assert debounce.debounce(debounce.passing(events(spark, *rows).limit(0)), 2000).count() == 0


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(source))
    for k, times in enumerate([(0, 1.5), (2.5, 4.6)]):
        events(spark, *[("modified", "/r/a.py", None, s) for s in times]).coalesce(1).write.mode("append").json(str(tmp_path / f"one{k}"))
        part = next((tmp_path / f"one{k}").glob("part-*.json"))
        part.rename(source / f"{k}.json")
    q = debounce.debounce_stream(debounce.passing(stream), 2000).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.ts - START).total_seconds() for r in spark.table("kept").collect())
    assert got == [0.0, 2.5, 4.6]


def test_snapshot_changes():
    assert changes({"a": [1, 1], "b": [1, 1], "c": [1, 1]}, {"a": [1, 1], "b": [2, 1], "d": [1, 1]}) == [("deleted", "c"), ("modified", "b"), ("created", "d")]


WATCHER = """
import sys, time
from pyspark.sql import SparkSession
from lodestone.sources.events import FolderEvents
root, base = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.dataSource.register(FolderEvents)
stream = spark.readStream.format("folder_events").option("path", root).option("state", "file://" + base + "/state").load()
def told(batch, n):
    for r in batch.collect():
        print("EVENT", r.event_type, r.file_path.removeprefix(root + "/"), flush=True)
q = stream.writeStream.foreachBatch(told).option("checkpointLocation", base + "/checkpoint").trigger(processingTime="300 milliseconds").start()
print("READY", flush=True)
while q.isActive:
    line = sys.stdin.readline()
    time.sleep(3)
    print("DONE", flush=True)
"""


@pytest.fixture
def watched(tmp_path):
    root = (tmp_path / "w").resolve()
    for name in ("top.py", "a/one.py", "a/b/two.py", "a/b/c/d/three.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("1")
    return root


def reader(root, base, **options):
    return FolderReader({"path": str(root), "state": str(base), **options})


def batch(r, start, end):
    begin = r.initialOffset() if start == 0 else {"n": start}
    return sorted(e[:2] for p in r.partitions(begin, {"n": end}) for e in r.read(p))


def test_source_by_batches(watched, tmp_path):
    r, at = reader(watched, tmp_path / "s"), lambda n: str(watched / n)
    assert batch(r, 0, 1) == []
    # What is written after the start is told by the first listing.
    late = reader(watched, tmp_path / "v", since=str((watched / "a/one.py").stat().st_mtime_ns))
    assert ("created", at("a/one.py")) in batch(late, 0, 1) and ("created", at("top.py")) not in batch(late, 0, 1)
    (watched / "top.py").write_text("22")
    (watched / "a/b/c/d/three.py").unlink()
    (watched / "new").mkdir()
    (watched / "new/x.py").write_text("1")
    want = [("created", at("new/x.py")), ("deleted", at("a/b/c/d/three.py")), ("modified", at("top.py"))]
    assert batch(r, 1, 2) == want
    # A batch that is run again, by another process and later, tells the same.
    shutil.rmtree(watched / "a")
    assert batch(reader(watched, tmp_path / "s"), 1, 2) == want
    again = reader(watched, tmp_path / "s")
    assert again.latestOffset() == {"n": 3} and batch(again, 2, 3) == [("deleted", at("a/b/two.py")), ("deleted", at("a/one.py"))] and batch(again, 3, 4) == []
    assert len(list((tmp_path / "s/seen").glob("*/*"))) <= 3 * len(list((tmp_path / "s/parts").iterdir()))
    assert batch(reader(watched, tmp_path / "t", existing="true"), 0, 1) == [("created", at("new/x.py")), ("created", at("top.py"))]
    assert batch(reader(watched, tmp_path / "u", existing="true", recursive="false"), 0, 1) == [("created", at("top.py"))]
    with pytest.raises(ValueError):
        FolderReader({"path": "/x"})


def test_a_restart_loses_no_event(watched, tmp_path):
    """A process is killed, files change, and another one goes on from its checkpoint."""

    def run():
        p = subprocess.Popen([sys.executable, "-c", WATCHER, str(watched), str(tmp_path / "base")], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
        assert p.stdout.readline().strip() == "READY"
        return p

    def step(p):
        p.stdin.write("go\n")
        p.stdin.flush()
        return [x.split()[1:] for x in iter(lambda: p.stdout.readline().strip(), "DONE") if x]

    def until(p, n):
        got = []
        for _ in range(12):
            got += step(p)
            if len(got) >= n:
                break
        return sorted(got)

    p = run()
    try:
        step(p)
        (watched / "a/first.py").write_text("1")
        assert until(p, 1) == [["created", "a/first.py"]]
    finally:
        p.kill()
        p.wait(30)
    (watched / "a/b/two.py").unlink()
    (watched / "away.py").write_text("1")
    p = run()
    try:
        assert until(p, 2) == [["created", "away.py"], ["deleted", "a/b/two.py"]]
    finally:
        p.kill()
        p.wait(30)


def test_state_of_quiet_files_goes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    q = debounce.debounce_stream(debounce.passing(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(source))), 2000, "1 second").writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, (name, s) in enumerate([("a", 0), ("b", 1), ("c", 100), ("a", 101)]):
            events(spark, ("modified", f"/r/{name}.py", None, s)).coalesce(1).write.json(str(tmp_path / f"one{k}"))
            next((tmp_path / f"one{k}").glob("part-*.json")).rename(source / f"{k}.json")
            q.processAllAvailable()
        got = sorted((r.file_path, (r.ts - START).total_seconds()) for r in spark.table("quiet").collect())
        assert got == [("/r/a.py", 0.0), ("/r/a.py", 101.0), ("/r/b.py", 1.0), ("/r/c.py", 100.0)]
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    finally:
        q.stop()


if __name__ == "__main__":
    pytest.main([__file__])
