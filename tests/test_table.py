"""The bucketed collection: what is appended, and that the stored side is not shuffled."""

import re

from filigree.operators.chunks import process_filing
from filigree.session import scratch_path
from filigree.sources.table import append_new, new_rows, open_table

DOCUMENTS = "ticker string, filing_type string, accession_number string, company string, filing_date string, text string"


def chunks(spark, names):
    rows = [(t, "10-K", f"000000000{i}-21-00000{i}", "", "", f"{t} text {i} " * 200) for i, t in enumerate(names)]
    return process_filing(spark.createDataFrame(rows, DOCUMENTS), None)


def test_appends_once_and_survives_the_catalogue(spark):
    path, name = scratch_path(spark, "table"), "bucketed_chunks"
    spark.sql(f"drop table if exists {name}")
    assert open_table(spark, name, path, 4).count() == 0
    first = chunks(spark, ["A", "B"])
    append_new(first, name, 4)
    append_new(first, name, 4)
    assert spark.table(name).count() == first.count() > 2
    both = chunks(spark, ["A", "B", "A", None])
    append_new(both.union(both), name, 4)
    append_new(both, name, 4)
    stored = open_table(spark, name, path, 4)
    key = ["chunk_id", "content", "ticker", "metadata"]
    assert sorted(map(str, stored.select(key).collect())) == sorted(map(str, both.select(key).collect()))
    spark.sql(f"drop table {name}")
    again = open_table(spark, name, path, 4)
    assert again.count() == both.count() and again.where("ticker = 'A'").count() == both.where("ticker = 'A'").count()
    spark.sql(f"drop table {name}")


def test_only_the_batch_is_shuffled(spark):
    path, name = scratch_path(spark, "table"), "bucketed_plan"
    spark.sql(f"drop table if exists {name}")
    open_table(spark, name, path, 8)
    append_new(chunks(spark, ["A", "B", "C"]), name, 8)
    rows = new_rows(chunks(spark, ["C", "D"]), name, 8)
    assert rows.count() == chunks(spark, ["C", "D"]).count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and len(re.findall(r"\bExchange hashpartitioning", plan)) <= 1 and "Bucketed: true" in plan
    spark.sql(f"drop table {name}")
