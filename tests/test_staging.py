import pytest

from newsloom.plans import staging
from newsloom.plans.staging import staged


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_staged_rows_live_in_the_shared_folder(spark):
    frame = spark.range(100).selectExpr("id", "cast(id % 3 AS string) AS k")
    kept = staged(frame)
    assert sorted(kept.collect()) == sorted(frame.collect())
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert all(folder in path for path in kept.inputFiles())
    assert staged(frame.filter("id < 0")).count() == 0


def test_staged_branches_read_their_columns_only(spark):
    kept = staged(spark.range(10).selectExpr("id", "'x' AS wide"))
    assert "ReadSchema: struct<id:bigint>" in plan(kept.select("id"))


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_path(Session(), "x")
