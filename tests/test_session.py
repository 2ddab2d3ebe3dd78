from types import SimpleNamespace

import pytest

from tallymill.session import SharedFiles, bucketed, clear_scratch, scratch, shared_dir, written
from tests.helpers import values


def test_written_tables_live_in_the_shared_folder(spark):
    df = written(spark.range(5), "numbers")
    assert shared_dir(spark).removeprefix("file://") in df.inputFiles()[0] and values(df) == [(k,) for k in range(5)]


def test_an_empty_table_keeps_its_schema(spark):
    assert written(spark.range(0), "nothing").columns == ["id"]


def test_the_cluster_names_the_folder():
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://shared/dir/"))
    assert shared_dir(named) == "hdfs://shared/dir"


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=context))


def test_scratch_can_be_cleared(spark):
    df = written(spark.range(5), "numbers")
    assert clear_scratch(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_publish_is_first_wins(spark, tmp_path):
    files = SharedFiles(spark, f"file://{tmp_path}/m")
    assert files.names() == []
    assert files.publish("a.json", "one") and not files.publish("a.json", "two")
    assert files.names() == ["a.json"] and files.read("a.json") == "one"
    files.delete("a.json")
    assert not files.exists("a.json")


def test_a_bucketed_table_is_known_by_its_path(spark):
    path = scratch(spark, "buckets")
    name = bucketed(spark, path, "k int, v int", "k", 4)
    spark.range(40).selectExpr("cast(id % 8 as int) as k", "cast(id as int) as v").write.insertInto(name, overwrite=True)
    assert bucketed(spark, path, "k int, v int", "k", 4) == name and spark.table(name).count() == 40
    assert "Exchange" not in spark.table(name).groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    clear_scratch(spark)
    assert not spark.catalog.tableExists(name)
