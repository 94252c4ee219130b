from siteloom.operators import inference as inf


def test_clusters_of_a_small_file_are_merged_not_broadcast(spark):
    cases = spark.range(3).selectExpr("cast(id as string) case_accession", "1 case_position")
    clusters = spark.range(2).selectExpr("cast(id as string) accession", "1 position", "if(id = 0, 'k0;z', '') ortholog_clusters")
    out = inf.with_cluster(cases, clusters)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r.ortholog_cluster for r in out.collect()) == ["k0", "solo:1", "solo:2"]
