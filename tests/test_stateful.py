import datetime
import time

from quire.streaming import stateful, watch


def run(spark, folder, rows, ttl):
    spark.createDataFrame(rows, "path string, content_hash string, mtime timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    watch.wait(stateful.decide(stateful.versions(spark, f"{folder}/versions"), f"{folder}/out", f"{folder}/state", ttl))
    return sorted((r.path, r.content_hash, r.action, r.seen) for r in spark.read.schema(stateful.OUTPUT).parquet(f"{folder}/out").collect())


def day(k):
    return datetime.datetime(2024, 1, k)


def test_state_outlives_the_query(spark, tmp_path):
    first = run(spark, tmp_path, [("a", "1", day(1)), ("b", "1", day(1))], 0)
    assert first == [("a", "1", "build", 1), ("b", "1", "build", 1)]
    after = run(spark, tmp_path, [("a", "1", day(2)), ("b", "3", day(3)), ("b", "2", day(2)), ("c", None, None)], 0)
    assert sorted(set(after) - set(first)) == [("a", "1", "skip", 1), ("b", "3", "build", 2), ("c", "", "build", 1)]


def test_what_is_old_is_forgotten(spark, tmp_path):
    run(spark, tmp_path, [("a", "1", day(1))], 1)
    time.sleep(2)
    assert run(spark, tmp_path, [("a", "1", day(2))], 1) == [("a", "1", "build", 1)] * 2


def test_versions_are_taken_row_by_row():
    """A frame for each path cost more than the path's rows."""
    from pyspark.sql import Row

    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    builds = stateful.Builds(0)
    builds.last = Held()
    rows = [Row(path="a", content_hash=h, mtime=m) for h, m in (("1", 1), ("3", 2), ("2", 2))]
    for action in ("build", "skip"):
        assert [r.asDict() for r in builds.handleInputRows(("a",), iter(rows), None)] == [{"path": "a", "content_hash": "3", "action": action, "seen": 3}]
