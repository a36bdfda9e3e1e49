from opsloom.plans import quality as ql
from opsloom.plans import tenancy as tn


def results(df):
    return {r["check_id"]: (r["violations"], r["status"]) for r in df.collect()}


def test_planted_defects(spark):
    runs = spark.createDataFrame(
        [(1, "pending", 1, "a"), (1, "bypassed", 0, "b"), (3, None, None, "c"), (None, "approved", 9, "a")],
        "id int, state string, attempt int, ref string")
    refs = spark.createDataFrame([("a",), ("b",)], "ref string")
    rules = (ql.TableRules(
        "runs", rows=(ql.allowed("state", "state", ("pending", "approved")), ql.between("attempt", "attempt", 1, None, "warning")),
        unique=(("id", ("id",), None), ("pending_id", ("id",), "state = 'pending'")),
        references=(("ref", "ref", "refs", "ref"),), columns=("id", "owner")),)
    got = ql.evaluate({"runs": runs, "refs": refs}, rules)
    assert results(got) == {
        "state": (1, "failed"), "attempt": (1, "warning"), "id": (1, "failed"), "pending_id": (0, "passed"),
        "ref": (1, "failed"), "columns_present": (1, "failed")}
    total = ql.rollup(got).first()
    assert (total["passed"], total["failed"], total["warnings"], total["overall"]) == (1, 4, 1, "failed")


def test_tenant_check_skips_empty_side(spark):
    a = spark.createDataFrame([(1, 7)], "p int, workspace_id int")
    b = spark.createDataFrame([(1, 8)], "p int, workspace_id int")
    assert ql.check_tenant(a, b, "p", "t").first()["status"] == "warning"
    assert ql.check_tenant(a.where("p > 9"), b, "p", "t").first()["status"] == "skipped"


def test_delete_modes(spark):
    kids = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "p int, n string")
    gone = spark.createDataFrame([(1,)], "p int")
    mode = lambda m: sorted(((r["p"], r["n"]) for r in ql.delete_cascade(kids, "p", gone, m).collect()), key=str)
    assert mode("cascade") == [(2, "b"), (None, "c")]
    assert mode("restrict") == [(1, "a")]
    assert mode("set_null") == [(2, "b"), (None, "a"), (None, "c")]


def test_permissions_count_equals_listing(spark):
    perms = spark.createDataFrame(
        [("u", None, "view"), ("u", 1, "view"), ("v", 1, "view"), ("v", 2, "approve")],
        "user_id string, workspace_id int, permission string")
    tasks = spark.createDataFrame(
        [(1, 1, "view", "pending"), (2, 2, "view", "pending"), (3, 2, "approve", "pending"), (4, 1, "view", "approved")],
        "task_id int, workspace_id int, required_permission string, approval_status string")
    counts = {r["user_id"]: r["n_tasks"] for r in tn.actionable_task_counts(tasks, perms).collect()}
    assert counts == {"u": 2, "v": 2}
    for user, n in counts.items():
        assert tn.actionable_tasks(tasks, perms, user).count() == n
