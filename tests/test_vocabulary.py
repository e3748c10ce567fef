"""Words looked up once and joined back to all lines."""

from tarifflake.plans import catalogue


def test_lines_with_one_word_are_shared_among_tasks(spark, tmp_path):
    rows = [(i, 1, i, 3, "A") for i in range(2000)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = catalogue.queries()["s02_vocabulary_lookup"](spark, str(tmp_path))
        sizes = [n for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
        found = {(r.meal_plan, r.occupancy, r.currency) for r in out.filter("l_orderkey is not null").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 2001 and max(sizes) < 600
    assert found == {("CP", "double", "INR")}
