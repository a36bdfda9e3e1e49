"""Intake sessions: gate, score, class, result, lead card and events.

A session is one row with its answers in an array, so scoring any number of
sessions is a projection over the scan: no join, no shuffle. Only the search
for knowledge passages moves data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import fixed_values as fv
from opsloom.functions import text as tx
from opsloom.operators.literals import lookup, text_array
from opsloom.operators.postings import best_chunks
from opsloom.operators.settle import settle

STEPS = tuple(fv.STEP_OPTIONS)


def normalise_sessions(sessions: DataFrame) -> DataFrame:
    """Answers as columns, per step: first position, options, free text, both joined.

    The last answer of a step counts, at the place of its first. Options are
    trimmed and, where the step lists them, kept only if allowed. Everything
    is read by position, so no step scans the answers of another.
    """
    none = F.array().cast("array<string>")
    placed = settle(sessions, {
        "step_ids": F.transform("answers", lambda a: a["step_id"]),
        "_backwards": F.reverse(F.transform("answers", lambda a: a["step_id"])),
        "_chosen": F.transform("answers", lambda a: F.filter(
            F.transform(F.coalesce(a["selected"], none), tx.strip), lambda o: o != "")),
        "_free": F.transform("answers", lambda a: tx.clean(a["free_text"])),
    })
    found = settle(placed, {f"pos_{s}": F.array_position("step_ids", s) for s in STEPS}
                   | {f"_end_{s}": F.array_position("_backwards", s) for s in STEPS})
    columns: dict[str, Column] = {}
    for step, options in fv.STEP_OPTIONS.items():
        from_end = F.col(f"_end_{step}")
        last = F.when(from_end > 0, F.size("step_ids") - from_end).cast("int")
        chosen = F.coalesce(F.get("_chosen", last), none)
        columns[f"options_{step}"] = (
            F.filter(chosen, lambda o: o.isin(*options)) if options else chosen)
        columns[f"free_{step}"] = F.coalesce(F.get("_free", last), F.lit(""))
    read = settle(found, columns).drop("_backwards", "_chosen", "_free", *[f"_end_{s}" for s in STEPS])
    joined = {}
    for step, options in fv.STEP_OPTIONS.items():
        text = F.concat_ws(" ", f"options_{step}", F.nullif(f"free_{step}", F.lit("")))
        joined[f"text_{step}"] = text if options else tx.clean(text)
    return settle(read, joined)


def gate(normalised: DataFrame) -> DataFrame:
    """Add unknown, empty and missing steps, in step order, and ``complete``."""
    steps = text_array(STEPS)
    empty = [F.when((F.col(f"pos_{s}") > 0) & (F.col(f"text_{s}") == ""), F.lit(s)) for s in STEPS]
    checked = settle(normalised, {
        "unknown_steps": F.array_except("step_ids", steps),
        "empty_steps": F.array_compact(F.array(*empty)),
        "missing_steps": F.array_except(steps, F.col("step_ids")),
    })
    return checked.withColumn(
        "complete",
        (F.size("unknown_steps") == 0) & (F.size("empty_steps") == 0) & (F.size("missing_steps") == 0),
    )


def answer_rows(normalised: DataFrame) -> DataFrame:
    """One row per given answer, with its place in the session."""
    rows = F.array_compact(F.array(*[
        F.when(F.col(f"pos_{s}") > 0, F.struct(
            F.col(f"pos_{s}").alias("position"), F.lit(s).alias("step_id"),
            F.col(f"options_{s}").alias("selected"), F.col(f"free_{s}").alias("free_text"),
            F.col(f"text_{s}").alias("normalized_text")))
        for s in STEPS]))
    return normalised.select("session_id", F.explode(rows).alias("a")).select("session_id", "a.*")


def session_text() -> Column:
    """One line per answer, in answer order; ``-`` marks an empty part."""
    lines = F.array_compact(F.array(*[
        F.when(F.col(f"pos_{s}") > 0, F.struct(
            F.col(f"pos_{s}").alias("position"),
            F.concat(
                F.lit(f"{s}: selected=["),
                F.coalesce(F.nullif(F.array_join(f"options_{s}", ", "), F.lit("")), F.lit("-")),
                F.lit("] text="),
                F.coalesce(F.nullif(f"free_{s}", F.lit("")), F.lit("-")),
            ).alias("line")))
        for s in STEPS]))
    return F.array_join(F.transform(F.sort_array(lines), lambda x: x["line"]), "\n")


def _selected(step: str) -> Column:
    return F.col(f"options_{step}")


def _free_text(step: str) -> Column:
    return F.col(f"free_{step}")


def _has_any(options: Column, words: Sequence[str]) -> Column:
    test = F.array_contains(options, words[0])
    for word in words[1:]:
        test = test | F.array_contains(options, word)
    return test


# Interpretation ------------------------------------------------------------


def interpret_mock(context_size: Column) -> dict[str, Column]:
    """Deterministic reading of the answers: systems, clarity hint, knowledge need."""
    text = F.col("query_text")
    return {
        "provider": F.lit("mock"),
        "summary": F.lit(fv.INTERPRETER_SUMMARIES["mock"]),
        "signal_systems": tx.known_systems(text),
        "signal_rules_clarity": F.when(text.contains("partially_clear"), "partially_clear")
        .otherwise("unknown"),
        "signal_knowledge_need": F.when(context_size > 0, "rag").otherwise("none"),
        "signal_process": F.lit(None).cast("string"),
        "signal_pain": F.lit(None).cast("string"),
        "interpreter_risks": F.array().cast("array<string>"),
    }


def interpret_none(context_size: Column) -> dict[str, Column]:
    """No interpretation: rules alone decide."""
    return {
        "provider": F.lit("none"),
        "summary": F.lit(fv.INTERPRETER_SUMMARIES["none"]),
        "signal_systems": F.array().cast("array<string>"),
        "signal_rules_clarity": F.lit(None).cast("string"),
        "signal_knowledge_need": F.lit("").cast("string"),
        "signal_process": F.lit(None).cast("string"),
        "signal_pain": F.lit(None).cast("string"),
        "interpreter_risks": F.array().cast("array<string>"),
    }


def interpret_table(context_size: Column) -> dict[str, Column]:
    """Answers of an external model, joined beforehand as ``model_*`` columns."""
    return {
        "provider": F.lit("table"),
        "summary": F.coalesce(F.col("model_summary"), F.lit("")),
        "signal_systems": F.coalesce("model_systems", F.array().cast("array<string>")),
        "signal_rules_clarity": F.col("model_rules_clarity"),
        "signal_knowledge_need": F.lower(F.coalesce("model_knowledge_need", F.lit(""))),
        "signal_process": F.col("model_process"),
        "signal_pain": F.col("model_pain"),
        "interpreter_risks": F.coalesce("model_risks", F.array().cast("array<string>")),
    }


INTERPRETERS = {"mock": interpret_mock, "none": interpret_none, "table": interpret_table}


def interpret(sessions: DataFrame, provider: str, context_size: str = "context_size") -> DataFrame:
    name = provider.strip().lower()
    if name not in INTERPRETERS:
        raise ValueError(f"unsupported interpreter: {provider}")
    asked = settle(sessions, {"query_text": session_text()})
    return settle(asked, INTERPRETERS[name](F.col(context_size)))


# Score ---------------------------------------------------------------------


def _tests() -> tuple[dict[str, Column], list[tuple[str, str, int, str | None, str | None]]]:
    """Every rule's condition by name, and (test, component, points, hit, flag)."""
    tests: dict[str, Column] = {}
    effects = []
    for component, step, mode, rules in fv.SCORE_GROUPS:
        taken = F.lit(False)
        for n, (words, points, hit, flag) in enumerate(rules):
            found = _has_any(_selected(step), words)
            name = f"_r_{component}_{n}"
            tests[name] = found & ~taken if mode == "first" else found
            taken = taken | found
            effects.append((name, component, points, hit, flag))
    systems = _selected("systems_involved")
    for n, (words, flag) in enumerate(fv.SYSTEM_FLAGS):
        tests[f"_r_systems_{n}"] = _has_any(systems, words)
        effects.append((f"_r_systems_{n}", "systems_digitization", 0, None, flag))
    all_text = F.lower(F.concat_ws(" ", *[f"text_{s}" for s in STEPS]))
    tests["_r_pain"] = all_text.rlike("|".join(fv.PAIN_TERMS))
    effects.append(("_r_pain", "impact", 6, "manual_repetitive_pain", None))
    tests["_r_knowledge"] = F.col("signal_knowledge_need").isin(*fv.KNOWLEDGE_MODES) | _has_any(
        systems, ("sap_b1", "erp"))
    effects.append(("_r_knowledge", "knowledge_need", 4, "knowledge_scope_recommended", None))
    return tests, effects


def score(sessions: DataFrame) -> DataFrame:
    """Eight components, total clamped to 0..100, rule hits, sorted risk flags.

    Conditions become boolean columns first; points, hits and flags read them.
    """
    tests, effects = _tests()
    digital = F.array_intersect("options_systems_involved", text_array(fv.DIGITAL_SYSTEMS))
    tested = settle(sessions, {**tests, "_digital": F.size(digital)})

    parts = {name: F.lit(0) for name in fv.SCORE_COMPONENTS}
    parts["systems_digitization"] = F.when(
        F.col("_digital") > 0, F.least(F.lit(18), 6 + F.col("_digital") * 3)).otherwise(0)
    hits = {"digital_systems_present": F.col("_digital") > 0}
    flags = []
    for test, component, points, hit, flag in effects:
        if points:
            parts[component] = parts[component] + F.when(F.col(test), points).otherwise(0)
        if hit:
            hits[hit] = F.col(test)
        if flag:
            flags.append(F.when(F.col(test), F.lit(flag)))
    scored = settle(tested, {f"score_{name}": parts[name].cast("int") for name in fv.SCORE_COMPONENTS})
    total = F.lit(50)
    for name in fv.SCORE_COMPONENTS:
        total = total + F.col(f"score_{name}")
    return settle(scored, {
        "score_total": F.greatest(F.lit(0), F.least(F.lit(100), total)),
        "rule_hits": F.array_compact(
            F.array(*[F.when(hits[h], F.lit(h)) for h in fv.RULE_HIT_ORDER])),
        "risk_flags": F.sort_array(F.array_distinct(
            F.concat(F.array_compact(F.array(*flags)), F.col("interpreter_risks")))),
    }).drop("_digital", *tests)


# Class and outputs ---------------------------------------------------------


def classify(scored: DataFrame, packages: dict[str, str] | None = None) -> DataFrame:
    """First matching branch decides class, mode, package, workers and actions."""
    codes = {**fv.PACKAGE_CODES, **(packages or {})}
    systems = _selected("systems_involved")
    has = lambda flag: F.array_contains("risk_flags", flag)
    hit = lambda rule: F.array_contains("rule_hits", rule)
    unclear = has("rules_unclear") | has("high_human_dependency") | has("high_sensitivity_data")
    operational = _has_any(systems, ("erp", "sap_b1", "browser_portal", "desktop_app")) | (
        (F.col("score_total") >= 70) & hit("volume_high_or_daily")
    )
    core = text_array(fv.CORE_WORKERS)
    with_approval = text_array([*fv.CORE_WORKERS, "approval_worker"])
    extra = F.array_compact(
        F.array(*[F.when(_has_any(systems, w), F.lit(name)) for w, name in fv.SYSTEM_WORKERS])
    )

    def outcome(name, mode, package, workers, actions) -> Column:
        return F.struct(
            (name if isinstance(name, Column) else F.lit(name)).alias("classification"),
            (mode if isinstance(mode, Column) else F.lit(mode)).alias("automation_mode"),
            F.lit(package).alias("recommended_package_type"),
            F.sort_array(F.array_distinct(workers)).alias("suggested_workers"),
            text_array(actions).alias("allowed_actions"),
        )

    low_volume = hit("volume_low")
    draft = ("read_data", "prepare_draft", "generate_report")
    decided = (
        F.when(has("hard_security_stop"), outcome(
            "not_recommended", "blocked", codes["security_stop"], core,
            ("document_process", "recommend_manual_path")))
        .when(F.col("score_total") < 45, outcome(
            F.when(low_volume, "not_recommended").otherwise("consulting_required"),
            F.when(low_volume, "blocked").otherwise("assisted"), codes["low_score"], core,
            ("analyze_process", "prepare_discovery_notes")))
        .when(unclear, outcome(
            "consulting_required", "approval_required", codes["unclear"], with_approval, draft))
        .when(operational, outcome(
            "operational_automation", "assisted", codes["operational"],
            F.concat(with_approval, extra), draft))
        .otherwise(outcome(
            "standard_package", "assisted", codes["standard"], with_approval,
            ("classify", "prepare_draft", "generate_report")))
    )
    credentials = F.array_compact(F.array(*[
        F.when(_has_any(systems, words), F.struct(
            F.lit(kind).alias("type"), F.lit(needed).alias("required"),
            F.lit("secret_ref_only").alias("storage")))
        for words, kind, needed in fv.SYSTEM_CREDENTIALS
    ]))
    return (
        settle(scored, {"_d": decided})
        .select("*", "_d.*").drop("_d")
        .withColumns({
            "blocked_actions": text_array(fv.BLOCKED_ACTIONS),
            "requires_human_approval": F.lit(True),
            "required_credentials": credentials,
            "future_graph_enabled": _has_any(systems, ("erp", "sap_b1"))
            | has("critical_business_impact"),
        })
    )


def user_result(classified: DataFrame) -> DataFrame:
    """Title, summary, limits and next step shown to the visitor."""
    limits = [
        F.when(F.array_contains("risk_flags", flag), F.lit(text)) for flag, text in fv.RESULT_LIMITS
    ]
    limits.append(F.when(F.col("requires_human_approval"), F.lit(fv.RESULT_APPROVAL_LIMIT)))
    return classified.withColumns({
        "result_title": lookup(F.col("classification"), fv.RESULT_TITLES),
        "result_summary": tx.default_blank(F.col("summary"), fv.RESULT_SUMMARY_DEFAULT),
        "result_limits": F.array_compact(F.array(*limits)),
        "result_next_step": lookup(F.col("classification"), fv.RESULT_NEXT_STEPS),
    })


def lead_card(classified: DataFrame) -> DataFrame:
    """Flat lead record; texts fall back to the interpreter's signals."""
    blank_null = lambda c: F.nullif(c, F.lit(""))
    return classified.select(
        F.lit("automation_opportunity").alias("lead_type"),
        "session_id", "workspace_id",
        F.coalesce(blank_null(_free_text("process_to_automate")), "signal_process").alias("process"),
        F.coalesce(blank_null(_free_text("business_pain")), "signal_pain").alias("business_pain"),
        F.array_sort(F.array_union(_selected("systems_involved"), F.col("signal_systems")))
        .alias("systems"),
        "classification", "automation_mode", "recommended_package_type", "suggested_workers",
        "score_total", "rule_hits", "risk_flags", "blocked_actions", "requires_human_approval",
        lookup(F.col("classification"), fv.CARD_NEXT_STEPS).alias("next_step"),
    )


def session_events(classified: DataFrame) -> DataFrame:
    """The five events of a classification, in order, with their payload."""
    c = F.col
    payloads = {
        "knowledge_retrieved": F.concat_ws("|", c("context_size").cast("string"), F.lit("rag")),
        "ai_interpretation_started": F.lit(""),
        "ai_interpretation_completed": c("provider"),
        "scoring_completed": F.concat_ws(
            "|", c("score_total").cast("string"), F.array_join("risk_flags", ",")),
        "classified": F.concat_ws(
            "|", c("classification"), c("score_total").cast("string"), c("automation_mode")),
    }
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("event_order"), F.lit(name).alias("event_name"),
                 payloads[name].alias("payload"))
        for i, name in enumerate(fv.SESSION_EVENTS)
    ])
    return classified.select("session_id", "workspace_id", F.explode(rows).alias("e")).select(
        "session_id", "workspace_id", "e.*"
    )


def knowledge_context(sessions: DataFrame, chunks: DataFrame, k: int = fv.KEYWORD_TOP_K) -> DataFrame:
    """Top passages per session; its answers, written as text, are the query.

    ``chunks`` holds (scope_id, chunk_id, title, content). A session asks only
    its own scope. Answers are mostly option codes, so many sessions ask with the
    same words: each distinct bag of words is scored once and its passages are
    joined back to the sessions.
    """
    asked = settle(sessions, {"_t": F.array_sort(tx.tokens(session_text()))}).select(
        "session_id", F.col("knowledge_scope_id").alias("scope"), "_t")
    asked = asked.withColumn("query_id", F.md5(F.concat_ws("\u0001", "scope", "_t")))
    bags = asked.groupBy("query_id").agg(F.first("scope").alias("scope"), F.first("_t").alias("_t"))
    terms = (
        bags.select("query_id", "scope", F.explode("_t").alias("token"))
        .groupBy("query_id", "scope", "token")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    bodies = chunks.select(F.col("scope_id").alias("scope"), "chunk_id",
                           tx.tokens(F.concat_ws(" ", "title", "content")).alias("tokens"))
    best = best_chunks(bodies, terms, k)
    return asked.select("session_id", "query_id", F.size("_t").alias("_n")).join(best, "query_id").select(
        "session_id", "chunk_id", F.bround(F.col("total") / F.col("_n"), 4).alias("score"), "rank_position")


def classify_sessions(sessions: DataFrame, context: DataFrame | None = None,
                      provider: str = "mock", packages: dict[str, str] | None = None) -> DataFrame:
    """Gate, interpret, score and classify complete sessions."""
    return classify_ready(gate(normalise_sessions(sessions)).where("complete"), context, provider, packages)


def classify_ready(ready: DataFrame, context: DataFrame | None = None,
                   provider: str = "mock", packages: dict[str, str] | None = None) -> DataFrame:
    """Interpret, score and classify sessions that passed the gate."""
    if context is None:
        ready = ready.withColumn("context_size", F.lit(0))
    else:
        sizes = context.groupBy("session_id").agg(F.count(F.lit(1)).alias("context_size"))
        ready = ready.join(sizes, "session_id", "left").withColumn(
            "context_size", F.coalesce("context_size", F.lit(0))
        )
    return classify(score(interpret(ready, provider)), packages)


def fold_actions(actions: DataFrame) -> DataFrame:
    """Session state from an action log (session_id, seq, action, step_id, value).

    Per step the last value wins and the first position is kept. All steps
    combine on the map side, so the log of one session may be of any length.
    """
    saves = actions.where("action = 'answer'").groupBy("session_id", "step_id").agg(
        F.max_by("value", "seq").alias("value"), F.min("seq").alias("first_seq")
    )
    answers = saves.groupBy("session_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_seq", "step_id", "value"))),
                lambda a: F.concat(a["step_id"], F.lit("="), a["value"]),
            ),
            ";",
        ).alias("answers")
    )
    heads = actions.groupBy("session_id").agg(
        F.when(F.bool_or(F.col("action") == "finalize"), "finalized").otherwise("started")
        .alias("status"),
        F.max_by("value", F.when(F.col("action") == "contact", F.col("seq"))).alias("contact"),
        F.count(F.lit(1)).alias("n_events"),
        F.max("seq").alias("last_seq"),
    )
    return heads.join(answers, "session_id", "left")
