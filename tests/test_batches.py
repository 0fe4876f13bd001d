"""Batches and responses made in one pass over their tables."""

from inkquest.plans import source_plans, stream_plans


def test_batches_are_written_by_many_tasks_from_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(400).withColumnRenamed("id", "source_id").mapInPandas(count, "source_id long")
    per_batch = stream_plans._write_batches(df, str(tmp_path / "in"), "source_id", 5)
    files = list((tmp_path / "in").glob("*.parquet"))
    assert len(files) > 5 and -(-len(files) // per_batch) <= 5 and seen.value == 400
    assert spark.read.parquet(str(tmp_path / "in")).distinct().count() == 400


def test_responses_are_dealt_by_the_order_only(spark):
    orders = spark.createDataFrame([(1, 7, "O", "a"), (2, 8, "P", "b"), (3, 9, "F", "c")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    lines = spark.createDataFrame([(1, 5), (1, 4), (1, 5), (2, 6)], "l_orderkey long, l_suppkey long")
    found = source_plans.responses({"orders": orders, "lineitem": lines}.__getitem__)
    assert "l_suppkey" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)
    got = {r["batch_id"]: r["response_text"] for r in found.collect()}
    assert sorted(got) == [1, 2] and got[1].index("Supplier 4") < got[1].index("Supplier 5")
