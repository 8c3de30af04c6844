from caseweave.operators import relational


def test_offers_are_joined_by_position(spark):
    """A cluster isn't joined with all its users: every document of it would meet every one of them."""
    own = spark.createDataFrame([(u, d) for u in range(5) for d in range(1, 40) if (u * 7 + d) % 3 == 0], "user LONG, doc_id LONG")
    clusters = spark.createDataFrame([(d, d % 4) for d in range(1, 60)], "doc_id LONG, cluster LONG")
    got = relational.suggest_for_all(own, clusters, 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "position" in line and "<=" in line]
    read = {u: {r.doc_id for r in own.collect() if r.user == u} for u in range(5)}
    want = {}
    for u in read:
        mine = {d % 4 for d in read[u]}
        want[u] = [d for d in range(1, 60) if d % 4 in mine and d not in read[u]][:3]
    found = {u: [r.doc_id for r in sorted(got.where(f"user = {u}").collect(), key=lambda r: r["rank"])] for u in range(5)}
    assert found == want
