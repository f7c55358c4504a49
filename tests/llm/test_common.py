import pytest

from tidemark.llm import common


def test_a_bound_on_arrow_batches_that_is_set_stays(spark):
    conf, key = spark.conf, common._BATCH_CONF
    before = conf.get(key, None)
    try:
        conf.set(key, "64m")
        out = common.map_docs(spark.range(5), ["id"], lambda ids: {"id": ids}, "id long")
        assert out.count() == 5 and conf.get(key) == "64m"
        conf.unset(key)
        common.map_docs(spark.range(5), ["id"], lambda ids: {"id": ids}, "id long")
        assert conf.get(key) == str(common.BATCH_BYTES)
    finally:
        conf.unset(key)
        if before is not None:
            conf.set(key, before)


def test_tables_split_by_a_column(spark):
    table = common.saved(spark.range(100).selectExpr("id", "cast(id % 3 as int) k"), by="k")
    assert table.columns == ["id", "k"] and table.where("k = 1").count() == 33
    assert "PartitionFilters: [isnotnull(k" in table.where("k = 1")._jdf.queryExecution().toString()
    common.dropped(table)


def test_a_cluster_without_a_shared_folder_raises():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_dir(Cluster())
