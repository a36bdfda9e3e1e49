import pytest

from opsloom.plans import diagnosis as dx

STEPS = ["process_to_automate", "business_pain", "systems_involved", "frequency_volume", "rules_clarity",
         "human_dependency", "access_security", "data_sensitivity", "expected_result", "economic_impact"]


def session(name, systems, frequency, rules, dependency, security, sensitivity, impact, skip=()):
    picked = {"systems_involved": systems, "frequency_volume": frequency, "rules_clarity": [rules],
              "human_dependency": [dependency], "access_security": security, "data_sensitivity": sensitivity,
              "economic_impact": [impact]}
    texts = {"process_to_automate": "Carga de pedidos", "business_pain": "proceso manual  y repetitivo",
             "expected_result": "reporte diario"}
    return (name, "ws", "kb", [(s, picked.get(s, []), texts.get(s, "")) for s in STEPS if s not in skip])


GOLDEN = [
    session("standard", ["excel", "email"], ["weekly", "medium_volume"], "clear", "low", ["password"],
            ["erp_operational_data"], "medium"),
    session("operational", ["whatsapp", "excel", "erp"], ["daily", "high_volume"], "partially_clear", "medium",
            ["password", "role_permissions"], ["personal_data", "erp_operational_data"], "high"),
    session("consulting", ["sap_b1", "excel", "email"], ["daily", "medium_volume"], "mostly_manual",
            "expert_judgement", ["totp", "role_permissions"], ["financial_data", "erp_operational_data"], "critical"),
    session("rejected", ["browser_portal"], ["monthly", "low_volume"], "unknown", "high",
            ["fido2_hardware", "biometric"], ["banking_or_payments", "financial_data"], "low"),
]
# class, mode, total, then the eight components; impact includes the pain bonus.
WANT = {
    "standard": ("standard_package", "assisted", 100, [10, 18, 12, 12, 0, -6, 14, 4], ["sensitive_data"]),
    "operational": ("operational_automation", "assisted", 100, [18, 10, 15, 5, 0, -6, 20, 4],
                    ["human_review_likely", "requires_erp_access", "rules_partially_clear", "sensitive_data"]),
    "consulting": ("consulting_required", "approval_required", 73, [18, -10, 15, -12, -8, -6, 22, 4],
                   ["critical_business_impact", "high_human_dependency", "requires_erp_access", "rules_unclear",
                    "sensitive_data", "validate_mfa"]),
    "rejected": ("not_recommended", "blocked", 0, [-8, -10, 9, -12, -35, -24, -2, 4],
                 ["browser_automation_candidate", "hard_security_stop", "high_human_dependency",
                  "high_sensitivity_data", "rules_unclear", "sensitive_data"]),
}
SCHEMA = ("session_id string, workspace_id string, knowledge_scope_id string, "
          "answers array<struct<step_id:string,selected:array<string>,free_text:string>>")


@pytest.fixture(scope="module")
def classified(spark):
    sessions = spark.createDataFrame(GOLDEN, SCHEMA)
    context = spark.createDataFrame([(g[0], "c1") for g in GOLDEN], "session_id string, chunk_id string")
    return dx.classify_sessions(sessions, context, "mock")


def test_golden_sessions(classified):
    from opsloom import fixed_values as fv

    rows = {r["session_id"]: r for r in classified.collect()}
    for name, (kind, mode, total, parts, flags) in WANT.items():
        r = rows[name]
        assert (r["classification"], r["automation_mode"], r["score_total"]) == (kind, mode, total), name
        assert [r[f"score_{c}"] for c in fv.SCORE_COMPONENTS] == parts, name
        assert r["risk_flags"] == flags, name
        assert r["requires_human_approval"] and "bypass_mfa" in r["blocked_actions"]
    assert rows["standard"]["recommended_package_type"] == "standard_automation"
    assert "erp_connector_or_rpa_worker" in rows["operational"]["suggested_workers"]
    assert [c["type"] for c in rows["operational"]["required_credentials"]] == ["erp_user", "messaging_provider"]


def test_outputs(classified):
    result = {r["session_id"]: r for r in dx.user_result(classified).collect()}
    assert len(result["consulting"]["result_limits"]) == 3
    card = {r["session_id"]: r for r in dx.lead_card(classified).collect()}
    assert card["operational"]["systems"] == ["erp", "excel", "whatsapp"]
    assert card["rejected"]["next_step"] == "manual_alternative_or_reject"
    events = dx.session_events(classified).where("session_id = 'standard'").orderBy("event_order").collect()
    assert [e["event_name"] for e in events][-1] == "classified"
    assert events[-1]["payload"] == "standard_package|100|assisted"


def test_gate_quarantines(spark):
    extra = session("extra", ["excel"], ["daily"], "clear", "low", ["password"], ["public"], "low")
    extra = (*extra[:3], [*extra[3], ("colour", ["red"], "")])
    none_allowed = session("empty", ["fax"], ["daily"], "clear", "low", ["password"], ["public"], "low")
    missing = session("missing", ["excel"], ["daily"], "clear", "low", ["password"], ["public"], "low",
                      skip=("rules_clarity", "business_pain"))
    rows = {r["session_id"]: r for r in dx.gate(dx.normalise_sessions(
        spark.createDataFrame([extra, none_allowed, missing, GOLDEN[0]], SCHEMA))).collect()}
    assert rows["extra"]["unknown_steps"] == ["colour"] and not rows["extra"]["complete"]
    assert rows["empty"]["empty_steps"] == ["systems_involved"]
    assert rows["missing"]["missing_steps"] == ["business_pain", "rules_clarity"]
    assert rows["standard"]["complete"]


def test_last_answer_wins_at_first_place(spark):
    answers = [("rules_clarity", ["unknown"], ""), ("business_pain", [], "  a   b "), ("rules_clarity", [" clear "], "")]
    df = dx.normalise_sessions(spark.createDataFrame([("s", "w", "k", answers)], SCHEMA))
    assert df.select(dx.session_text().alias("t")).first()["t"] == (
        "rules_clarity: selected=[clear] text=-\nbusiness_pain: selected=[-] text=a b")


def test_unknown_interpreter(spark):
    with pytest.raises(ValueError):
        dx.interpret(spark.range(1), "oracle")


def test_context_keeps_to_scope(spark):
    sessions = dx.normalise_sessions(spark.createDataFrame(GOLDEN[:1], SCHEMA))
    chunks = spark.createDataFrame(
        [("kb", "a", "Excel", "excel email excel"), ("kb", "b", "x", "nothing here"), ("other", "c", "e", "excel")],
        "scope_id string, chunk_id string, title string, content string")
    rows = dx.knowledge_context(sessions, chunks).collect()
    assert [r["chunk_id"] for r in rows] == ["a"]


def test_fold_actions(spark):
    log = [("s", 1, "start", None, "x"), ("s", 2, "answer", "b", "1"), ("s", 3, "answer", "a", "2"),
           ("s", 4, "answer", "b", "9"), ("s", 5, "contact", None, "mail"), ("s", 6, "finalize", None, None)]
    r = dx.fold_actions(spark.createDataFrame(
        log, "session_id string, seq long, action string, step_id string, value string")).first()
    assert (r["answers"], r["status"], r["contact"], r["n_events"]) == ("b=9;a=2", "finalized", "mail", 6)
