"""What a round costs."""

from weftgraph.graph import Graph
from weftgraph.operators import analytics


def test_a_round_of_pagerank_is_one_job(spark):
    g = Graph.directed(spark.createDataFrame([(i, i * j % 50) for i in range(50) for j in range(1, 6)], "src long, dst long"), 50)

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds{rounds}", "")
        analytics.pagerank(g, rounds)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds{rounds}"))

    adaptive, threshold = (spark.conf.get(f"spark.sql.{k}") for k in ("adaptive.enabled", "autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables
    try:
        assert jobs(8) - jobs(3) == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
