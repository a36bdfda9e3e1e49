"""Queries over intake sessions, derived from ``orders``: one session per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.catalogue.registry import Tables, plain, query
from opsloom.catalogue.text import sql_list, sql_tokens
from opsloom.operators.literals import text_array
from opsloom.plans import diagnosis as dx
from opsloom.session import cut_lineage

# One row per session; options are comma-joined so both engines read the text.
WIDE = """
SELECT o_orderkey AS session_id, concat('ws', CAST(o_custkey % 7 AS STRING)) AS workspace_id,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'carga  manual de pedidos' WHEN 1 THEN 'small ring quotes'
    WHEN 2 THEN ' red widget stock ' WHEN 3 THEN 'SAP B1 invoices via email' ELSE 'steel bolt orders' END AS process,
  CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'demora' WHEN 1 THEN 'lost messages' WHEN 2 THEN 'errores' ELSE 'slow' END AS pain,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'whatsapp,excel,erp' WHEN '2-HIGH' THEN 'excel,email'
    WHEN '3-MEDIUM' THEN 'sap_b1,excel,email,fax' WHEN '5-LOW' THEN 'browser_portal' ELSE 'desktop_app,other' END AS systems,
  CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'daily,high_volume' WHEN 1 THEN 'weekly,medium_volume'
    WHEN 2 THEN 'monthly,low_volume' WHEN 3 THEN 'daily,low_volume' ELSE 'never' END AS frequency,
  CASE o_orderstatus WHEN 'F' THEN 'clear' WHEN 'O' THEN 'partially_clear' ELSE
    CASE WHEN o_custkey % 2 = 0 THEN 'mostly_manual' ELSE 'unknown' END END AS rules,
  CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'expert_judgement'
    WHEN 4 THEN 'high' ELSE 'medium' END AS dependency,
  CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'password' WHEN 1 THEN 'password,role_permissions' WHEN 2 THEN 'totp,role_permissions'
    WHEN 3 THEN 'fido2_hardware,biometric' WHEN 4 THEN 'sms_otp,unknown' ELSE 'unknown' END AS access,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'public' WHEN 1 THEN 'personal_data,erp_operational_data'
    WHEN 2 THEN 'banking_or_payments,financial_data' ELSE 'public' END AS sensitivity,
  CASE WHEN o_totalprice < 20000 THEN '' ELSE 'a weekly report' END AS expected,
  CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'medium'
    WHEN o_totalprice < 400000 THEN 'high' ELSE 'critical' END AS impact,
  CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END AS skips_impact
FROM {orders}
"""

_STEPS = (
    ("process_to_automate", None, "process"), ("business_pain", None, "pain"),
    ("systems_involved", "systems", None), ("frequency_volume", "frequency", None),
    ("rules_clarity", "rules", None), ("human_dependency", "dependency", None),
    ("access_security", "access", None), ("data_sensitivity", "sensitivity", None),
    ("expected_result", None, "expected"), ("economic_impact", "impact", None),
)


def sessions(t: Tables) -> DataFrame:
    # Work per session is heavy and its columns are few: dealt out before it, however few files hold them.
    wide = t.derive(WIDE.replace("{orders}", "{wide_orders}"), wide_orders=t.orders).repartition("session_id")
    answers = [
        F.struct(
            F.lit(step).alias("step_id"),
            (F.split(F.col(options), ",") if options else F.array().cast("array<string>")).alias("selected"),
            (F.col(text) if text else F.lit("")).alias("free_text"),
        )
        for step, options, text in _STEPS
    ]
    given = F.filter(F.array(*answers),
                     lambda a: (F.col("skips_impact") == 0) | (a["step_id"] != "economic_impact"))
    return wide.select(
        "session_id", "workspace_id", F.lit("kb").alias("knowledge_scope_id"), given.alias("answers"))


def knowledge(t: Tables) -> DataFrame:
    """Knowledge passages: one per product type, made of its product names."""
    return t.part.groupBy("p_type").agg(
        F.array_join(F.array_sort(F.collect_set("p_name")), ". ").alias("content")
    ).select(F.lit("kb").alias("scope_id"), F.col("p_type").alias("chunk_id"),
             F.col("p_type").alias("title"), "content")


def classified(t: Tables) -> DataFrame:
    # Two steps read the gated sessions, so they are built once and kept.
    ready = cut_lineage(dx.gate(dx.normalise_sessions(sessions(t))).where("complete"))
    return dx.classify_ready(ready, dx.knowledge_context(ready, knowledge(t)), "mock")


# The same rules in SQL, over the wide form.
def _kept(column: str, step: str) -> str:
    return (f"list_filter(string_split({column}, ','), lambda s: "
            f"list_contains({sql_list(fv.STEP_OPTIONS[step])}, s))")


_BASE = f"""
wide AS ({plain(WIDE)}),
n AS (SELECT session_id, workspace_id, trim(regexp_replace(process, '\\s+', ' ', 'g')) AS process, pain, expected,
  skips_impact, {_kept('systems', 'systems_involved')} AS sy, {_kept('frequency', 'frequency_volume')} AS fr,
  rules, dependency, {_kept('access', 'access_security')} AS ac, {_kept('sensitivity', 'data_sensitivity')} AS se,
  impact FROM wide),
ok AS (SELECT *, CASE WHEN len(fr) = 0 THEN 'frequency_volume' ELSE '' END || '|' ||
    CASE WHEN expected = '' THEN 'expected_result' ELSE '' END AS empties,
  CASE WHEN skips_impact = 1 THEN 'economic_impact' ELSE '' END AS missing FROM n),
done AS (SELECT *, array_to_string(sy, ', ') AS sys_text,
  'process_to_automate: selected=[-] text=' || process || chr(10) || 'business_pain: selected=[-] text=' || pain || chr(10) ||
  'systems_involved: selected=[' || array_to_string(sy, ', ') || '] text=-' || chr(10) ||
  'frequency_volume: selected=[' || array_to_string(fr, ', ') || '] text=-' || chr(10) ||
  'rules_clarity: selected=[' || rules || '] text=-' || chr(10) ||
  'human_dependency: selected=[' || dependency || '] text=-' || chr(10) ||
  'access_security: selected=[' || array_to_string(ac, ', ') || '] text=-' || chr(10) ||
  'data_sensitivity: selected=[' || array_to_string(se, ', ') || '] text=-' || chr(10) ||
  'expected_result: selected=[-] text=' || expected || chr(10) ||
  'economic_impact: selected=[' || impact || '] text=-' AS qtext
  FROM ok WHERE empties = '|' AND missing = ''),
kb AS (SELECT p_type, p_type || ' ' || string_agg(DISTINCT p_name, '. ' ORDER BY p_name) AS content FROM part GROUP BY p_type),
kt AS (SELECT p_type, token, count(*) AS tf FROM (SELECT p_type, unnest({sql_tokens('content')}) AS token FROM kb) GROUP BY ALL),
st AS (SELECT session_id, unnest({sql_tokens('qtext')}) AS token FROM done),
sn AS (SELECT session_id, count(*) AS nq FROM st GROUP BY ALL),
sq AS (SELECT session_id, token, count(*) AS qtf FROM st GROUP BY ALL),
ks AS (SELECT session_id, p_type AS chunk_id, sum(qtf * tf)::DOUBLE / any_value(nq) AS s
  FROM sq JOIN kt USING (token) JOIN sn USING (session_id) GROUP BY session_id, p_type),
kr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, chunk_id) AS r FROM ks),
cx AS (SELECT session_id, count(*) AS context_size FROM kr WHERE r <= 5 GROUP BY session_id),
p AS (SELECT done.*, coalesce(context_size, 0) AS context_size,
  CASE WHEN list_has_any(fr, ['high_volume', 'daily']) THEN 18 WHEN list_has_any(fr, ['medium_volume', 'weekly']) THEN 10
       WHEN list_has_any(fr, ['low_volume', 'monthly']) THEN -8 ELSE 0 END AS volume,
  CASE rules WHEN 'clear' THEN 18 WHEN 'partially_clear' THEN 10 ELSE -10 END AS clarity,
  CASE WHEN len(list_filter(sy, lambda s: s <> 'other')) > 0 THEN least(18, 6 + 3 * len(list_filter(sy, lambda s: s <> 'other'))) ELSE 0 END AS digital,
  CASE dependency WHEN 'low' THEN 12 WHEN 'medium' THEN 5 ELSE -12 END AS human,
  CASE WHEN list_has_any(ac, ['email_otp', 'sms_otp', 'totp', 'push_or_qr']) THEN -8 ELSE 0 END
   + CASE WHEN list_has_any(ac, ['fido2_hardware', 'biometric']) THEN -35 ELSE 0 END
   + CASE WHEN list_contains(ac, 'unknown') THEN -8 ELSE 0 END AS security,
  CASE WHEN list_has_any(se, ['financial_data', 'erp_operational_data', 'personal_data']) THEN -6 ELSE 0 END
   + CASE WHEN list_has_any(se, ['banking_or_payments', 'religious_or_sensitive']) THEN -18 ELSE 0 END AS sensitivity,
  regexp_matches(lower(process || ' ' || pain || ' ' || rules || ' ' || expected), 'manual|repetitivo|errores|demora|copian|carga') AS pained
  FROM done LEFT JOIN cx USING (session_id)),
sc AS (SELECT *, CASE impact WHEN 'critical' THEN 16 WHEN 'high' THEN 14 WHEN 'medium' THEN 8 ELSE -8 END
   + CASE WHEN pained THEN 6 ELSE 0 END AS imp,
  CASE WHEN context_size > 0 OR list_has_any(sy, ['erp', 'sap_b1']) THEN 4 ELSE 0 END AS knowledge FROM p),
s AS (SELECT *, greatest(0, least(100, 50 + volume + clarity + digital + human + security + sensitivity + imp + knowledge)) AS total,
  list_sort(list_filter([
    CASE WHEN rules = 'partially_clear' THEN 'rules_partially_clear' WHEN rules <> 'clear' THEN 'rules_unclear' END,
    CASE WHEN list_has_any(sy, ['erp', 'sap_b1']) THEN 'requires_erp_access' END,
    CASE WHEN list_contains(sy, 'browser_portal') THEN 'browser_automation_candidate' END,
    CASE WHEN list_contains(sy, 'desktop_app') THEN 'desktop_automation_candidate' END,
    CASE dependency WHEN 'low' THEN NULL WHEN 'medium' THEN 'human_review_likely' ELSE 'high_human_dependency' END,
    CASE WHEN list_has_any(ac, ['email_otp', 'sms_otp', 'totp', 'push_or_qr']) THEN 'validate_mfa' END,
    CASE WHEN list_has_any(ac, ['fido2_hardware', 'biometric']) THEN 'hard_security_stop' END,
    CASE WHEN list_contains(ac, 'unknown') THEN 'unknown_access_security' END,
    CASE WHEN list_has_any(se, ['financial_data', 'erp_operational_data', 'personal_data']) THEN 'sensitive_data' END,
    CASE WHEN list_has_any(se, ['banking_or_payments', 'religious_or_sensitive']) THEN 'high_sensitivity_data' END,
    CASE WHEN impact = 'critical' THEN 'critical_business_impact' END], lambda f: f IS NOT NULL)) AS flags FROM sc),
c AS (SELECT *, CASE WHEN list_contains(flags, 'hard_security_stop') THEN 'stop' WHEN total < 45 THEN 'low'
   WHEN list_has_any(flags, ['rules_unclear', 'high_human_dependency', 'high_sensitivity_data']) THEN 'unclear'
   WHEN list_has_any(sy, ['erp', 'sap_b1', 'browser_portal', 'desktop_app']) OR (total >= 70 AND volume = 18) THEN 'ops'
   ELSE 'std' END AS branch FROM s),
k AS (SELECT *, CASE branch WHEN 'stop' THEN 'not_recommended' WHEN 'low' THEN CASE WHEN volume = -8 THEN 'not_recommended' ELSE 'consulting_required' END
   WHEN 'unclear' THEN 'consulting_required' WHEN 'ops' THEN 'operational_automation' ELSE 'standard_package' END AS classification,
  CASE branch WHEN 'stop' THEN 'blocked' WHEN 'low' THEN CASE WHEN volume = -8 THEN 'blocked' ELSE 'assisted' END
   WHEN 'unclear' THEN 'approval_required' ELSE 'assisted' END AS automation_mode,
  CASE branch WHEN 'stop' THEN 'consulting_security_review' WHEN 'low' THEN 'consulting_prior_assessment'
   WHEN 'unclear' THEN 'consulting_discovery' WHEN 'ops' THEN 'ops_starter' ELSE 'standard_automation' END AS package,
  array_to_string(list_sort(list_filter(['diagnosis_ai_interpreter', 'workflow_classifier',
    CASE WHEN branch IN ('unclear', 'ops', 'std') THEN 'approval_worker' END,
    CASE WHEN branch = 'ops' AND list_has_any(sy, ['erp', 'sap_b1']) THEN 'erp_connector_or_rpa_worker' END,
    CASE WHEN branch = 'ops' AND list_contains(sy, 'whatsapp') THEN 'whatsapp_intake_worker' END,
    CASE WHEN branch = 'ops' AND list_contains(sy, 'browser_portal') THEN 'browser_worker' END,
    CASE WHEN branch = 'ops' AND list_contains(sy, 'desktop_app') THEN 'desktop_worker' END], lambda w: w IS NOT NULL)), '|') AS workers
  FROM c)
"""


def _step_sql(step: str, column: str, listed: bool) -> str:
    text = f"array_to_string({column}, '|')" if listed else column
    words = f"array_to_string({column}, ' ')" if listed else column
    given = " WHERE skips_impact = 0" if step == "economic_impact" else ""
    picked = step not in ("process_to_automate", "business_pain", "expected_result")
    return (f"SELECT session_id, '{step}' AS step_id, {text if picked else chr(39) * 2} AS selected, "
            f"{chr(39) * 2 if picked else column} AS free_text, {words} AS normalized_text FROM n{given}")


@query("answers_normalise", f"WITH {_BASE}" + " UNION ALL ".join(_step_sql(*x) for x in (
    ("process_to_automate", "process", False), ("business_pain", "pain", False), ("systems_involved", "sy", True),
    ("frequency_volume", "fr", True), ("rules_clarity", "rules", False), ("human_dependency", "dependency", False),
    ("access_security", "ac", True), ("data_sensitivity", "se", True), ("expected_result", "expected", False),
    ("economic_impact", "impact", False))))
def answers_normalise(t: Tables):
    rows = dx.answer_rows(dx.normalise_sessions(sessions(t)))
    return rows.select(
        "session_id", "step_id", F.array_join("selected", "|").alias("selected"), "free_text", "normalized_text")


@query("session_gate", f"WITH {_BASE}" + """
SELECT session_id, trim(replace(empties, '||', '|'), '|') AS empty_steps, missing AS missing_steps,
  CASE WHEN empties = '|' AND missing = '' THEN 'ready' ELSE 'rejected' END AS state FROM ok
""")
def session_gate(t: Tables):
    rows = dx.gate(dx.normalise_sessions(sessions(t)))
    return rows.select(
        "session_id", F.array_join("empty_steps", "|").alias("empty_steps"),
        F.array_join("missing_steps", "|").alias("missing_steps"),
        F.when(F.col("complete"), "ready").otherwise("rejected").alias("state"))


@query("session_text", f"WITH {_BASE} SELECT session_id, qtext AS query_text FROM done")
def session_text(t: Tables):
    rows = dx.gate(dx.normalise_sessions(sessions(t))).where("complete")
    return rows.select("session_id", dx.session_text().alias("query_text"))


@query("session_context", f"WITH {_BASE}" + """
SELECT session_id, chunk_id, round_even(s, 4)::DOUBLE AS score, r AS rank_position FROM kr WHERE r <= 5
""")
def session_context(t: Tables):
    rows = dx.gate(dx.normalise_sessions(sessions(t))).where("complete")
    return dx.knowledge_context(rows, knowledge(t)).withColumn(
        "rank_position", F.col("rank_position").cast("long"))


@query("session_score", f"WITH {_BASE}" + """
SELECT session_id, volume::BIGINT AS volume, clarity::BIGINT AS rules_clarity, digital::BIGINT AS systems_digitization,
  human::BIGINT AS human_dependency, security::BIGINT AS security_risk, sensitivity::BIGINT AS data_sensitivity,
  imp::BIGINT AS impact, knowledge::BIGINT AS knowledge_need, total::BIGINT AS score_total, array_to_string(flags, '|') AS risk_flags,
  array_to_string(list_filter([CASE volume WHEN 18 THEN 'volume_high_or_daily' WHEN 10 THEN 'volume_medium' WHEN -8 THEN 'volume_low' END,
    CASE rules WHEN 'clear' THEN 'rules_clear' WHEN 'partially_clear' THEN 'rules_partially_clear' END,
    CASE WHEN digital > 0 THEN 'digital_systems_present' END,
    CASE WHEN list_has_any(ac, ['fido2_hardware', 'biometric']) THEN 'hardware_or_biometric_security' END,
    CASE WHEN pained THEN 'manual_repetitive_pain' END, CASE WHEN knowledge > 0 THEN 'knowledge_scope_recommended' END],
    lambda h: h IS NOT NULL), '|') AS rule_hits FROM s
""")
def session_score(t: Tables):
    rows = classified(t)
    return rows.select(
        "session_id", *[F.col(f"score_{c}").cast("long").alias(c) for c in fv.SCORE_COMPONENTS],
        F.col("score_total").cast("long").alias("score_total"),
        F.array_join("risk_flags", "|").alias("risk_flags"),
        F.array_join("rule_hits", "|").alias("rule_hits"))


@query("session_classify", f"WITH {_BASE}" + """
SELECT session_id, classification, automation_mode, package AS recommended_package_type, workers AS suggested_workers,
  CASE branch WHEN 'stop' THEN 'document_process|recommend_manual_path' WHEN 'low' THEN 'analyze_process|prepare_discovery_notes'
    WHEN 'std' THEN 'classify|prepare_draft|generate_report' ELSE 'read_data|prepare_draft|generate_report' END AS allowed_actions,
  array_to_string(list_filter([CASE WHEN list_has_any(sy, ['erp', 'sap_b1']) THEN 'erp_user' END,
    CASE WHEN list_contains(sy, 'browser_portal') THEN 'browser_session_or_portal_user' END,
    CASE WHEN list_contains(sy, 'desktop_app') THEN 'desktop_user_or_rdp_user' END,
    CASE WHEN list_contains(sy, 'whatsapp') THEN 'messaging_provider' END], lambda x: x IS NOT NULL), '|') AS credentials,
  (list_has_any(sy, ['erp', 'sap_b1']) OR impact = 'critical')::INT AS future_graph_enabled FROM k
""")
def session_classify(t: Tables):
    return classified(t).select(
        "session_id", "classification", "automation_mode", "recommended_package_type",
        F.array_join("suggested_workers", "|").alias("suggested_workers"),
        F.array_join("allowed_actions", "|").alias("allowed_actions"),
        F.array_join(F.transform("required_credentials", lambda c: c["type"]), "|").alias("credentials"),
        F.col("future_graph_enabled").cast("int").alias("future_graph_enabled"))


@query("user_result", f"WITH {_BASE}" + f"""
SELECT session_id, CASE classification {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.RESULT_TITLES.items())} END AS title,
  CASE classification {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.RESULT_NEXT_STEPS.items())} END AS next_step,
  (1 + len(list_intersect(flags, ['validate_mfa', 'hard_security_stop', 'requires_erp_access'])))::BIGINT AS n_limits FROM k
""")
def user_result(t: Tables):
    return dx.user_result(classified(t)).select(
        "session_id", F.col("result_title").alias("title"), F.col("result_next_step").alias("next_step"),
        F.size("result_limits").cast("long").alias("n_limits"))


@query("lead_card", f"WITH {_BASE}" + f"""
SELECT session_id, workspace_id, process, pain AS business_pain,
  array_to_string(list_sort(list_distinct(list_concat(sy, list_filter({sql_list(fv.KNOWN_SYSTEMS)},
    lambda w: regexp_matches(lower(qtext), '\\b' || w || '\\b'))))), '|') AS systems, total::BIGINT AS score_total,
  CASE classification {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.CARD_NEXT_STEPS.items())} END AS next_step FROM k
""")
def lead_card(t: Tables):
    return dx.lead_card(classified(t)).select(
        "session_id", "workspace_id", "process", "business_pain", F.array_join("systems", "|").alias("systems"),
        F.col("score_total").cast("long").alias("score_total"), "next_step")


@query("session_events", f"WITH {_BASE}" + """
SELECT session_id, 1::BIGINT AS event_order, 'knowledge_retrieved' AS event_name, context_size || '|rag' AS payload FROM k
UNION ALL SELECT session_id, 2, 'ai_interpretation_started', '' FROM k
UNION ALL SELECT session_id, 3, 'ai_interpretation_completed', 'mock' FROM k
UNION ALL SELECT session_id, 4, 'scoring_completed', total || '|' || array_to_string(flags, ',') FROM k
UNION ALL SELECT session_id, 5, 'classified', classification || '|' || total || '|' || automation_mode FROM k
""")
def session_events(t: Tables):
    return dx.session_events(classified(t)).select(
        "session_id", F.col("event_order").cast("long").alias("event_order"), "event_name", "payload")


@query("interpreter_choice", f"WITH {_BASE}" + """
SELECT session_id, 'none' AS provider, '' AS systems FROM done UNION ALL
SELECT session_id, 'mock', array_to_string(list_filter(['sap', 'sap b1', 'erp', 'excel', 'whatsapp', 'email', 'portal', 'browser',
  'desktop', 'api'], lambda w: regexp_matches(lower(qtext), '\\b' || w || '\\b')), '|') FROM done UNION ALL
SELECT session_id, 'table', CASE WHEN rules = 'clear' THEN 'crm' ELSE '' END FROM done
""")
def interpreter_choice(t: Tables):
    """Three interpreters over the same sessions; the third reads a table of model replies."""
    ready = dx.gate(dx.normalise_sessions(sessions(t))).where("complete").withColumn("context_size", F.lit(1))
    replies = t.orders.where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("session_id"), F.lit("s").alias("model_summary"),
        text_array(["crm"]).alias("model_systems"), F.lit("clear").alias("model_rules_clarity"),
        F.lit("rag").alias("model_knowledge_need"), F.lit(None).cast("string").alias("model_process"),
        F.lit(None).cast("string").alias("model_pain"), F.array().cast("array<string>").alias("model_risks"))
    joined = ready.join(replies, "session_id", "left")
    parts = [dx.interpret(joined, name).select(
        "session_id", "provider", F.array_join("signal_systems", "|").alias("systems"))
        for name in dx.INTERPRETERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ACTIONS = """
SELECT CAST(user_id AS BIGINT) AS session_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'contact' WHEN 'error' THEN
    CASE WHEN value > 200 THEN 'finalize' ELSE 'answer' END ELSE 'answer' END AS action,
  CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'systems_involved' WHEN 1 THEN 'business_pain' ELSE 'rules_clarity' END AS step_id,
  CAST(CAST(floor(value) AS INT) AS STRING) AS value FROM {events}
"""


@query("session_save", "WITH a AS (" + plain(_ACTIONS) + """),
l AS (SELECT session_id, step_id, max_by(value, seq) AS value, min(seq) AS f FROM a WHERE action = 'answer' GROUP BY ALL),
j AS (SELECT session_id, string_agg(step_id || '=' || value, ';' ORDER BY f) AS answers FROM l GROUP BY session_id),
h AS (SELECT session_id, CASE WHEN bool_or(action = 'finalize') THEN 'finalized' ELSE 'started' END AS status,
  max_by(value, seq) FILTER (WHERE action = 'contact') AS contact, count(*)::BIGINT AS n_events FROM a GROUP BY session_id)
SELECT session_id, status, contact, n_events, answers FROM h LEFT JOIN j USING (session_id)
""")
def session_save(t: Tables):
    return dx.fold_actions(t.derive(_ACTIONS)).select(
        "session_id", "status", "contact", "n_events", "answers")
