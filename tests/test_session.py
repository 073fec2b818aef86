"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from filigree import session as S


def fake(path, master):
    context = SimpleNamespace(master=master, applicationId="fake")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: path), sparkContext=context)


def test_shared_dir():
    assert S.shared_dir(fake("/shared/x", "yarn")) == "/shared/x"
    with pytest.raises(RuntimeError):
        S.shared_dir(fake(None, "yarn"))
    local = S.shared_dir(fake(None, "local[2]"))
    assert local == S.shared_dir(fake(None, "local[2]"))
    assert S.scratch_path(fake("/shared/x/", "yarn"), "t").startswith("/shared/x/t-")


def test_materialize_and_spread(spark):
    from filigree.plans.standins import spread

    df = spark.range(10).selectExpr("id", "array(id) as a")
    stored = S.materialize(df, "t")
    assert stored.schema.simpleString() == df.schema.simpleString() and stored.count() == 10
    assert S.materialize(df.limit(0), "t").count() == 0
    assert spread(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df.repartition(70)).rdd.getNumPartitions() == 70
