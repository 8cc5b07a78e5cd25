"""Registered queries over the conversations table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from careflow.functions import triage_scored as TS
from careflow.operators import transcripts as TR
from careflow.plans import domain as D
from careflow.plans import oracle_text as OT
from careflow.plans.registry import register
from careflow.session import ensure_checkpoint_dir

_S = TR.PY_WS


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _turns(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


SQL_USER_TEXT = f"""
  SELECT conv_id, {_strip(f"string_agg({_strip('text')}, ' ' ORDER BY turn)")} AS user_text
  FROM conversations WHERE role = 'user' AND coalesce(text, '') <> '' GROUP BY conv_id"""


@register("conversation_user_text", "SELECT * FROM (" + SQL_USER_TEXT + ") _u")
def q_conversation_user_text(spark, sf):
    """J1."""
    return TR.user_text(_turns(spark, sf))


@register(
    "conversation_first_user",
    """SELECT conv_id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS first_user_text
  FROM conversations GROUP BY conv_id""",
)
def q_conversation_first_user(spark, sf):
    """J2."""
    return TR.first_user_text(_turns(spark, sf))


_S_TEXT = _strip("coalesce(text, '')")


@register(
    "conversation_last_reply",
    f"""SELECT conv_id, coalesce(arg_max({_S_TEXT}, turn) FILTER (
      WHERE role = 'assistant' AND {_S_TEXT} <> '' AND NOT starts_with({_S_TEXT}, {OT.q(TR.REPLY_HIDDEN_PREFIX)})), '') AS last_reply
  FROM conversations GROUP BY conv_id""",
)
def q_conversation_last_reply(spark, sf):
    """J3."""
    return TR.last_assistant_text(_turns(spark, sf))


@register(
    "conversation_transcript",
    """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS assistant_text
  FROM conversations WHERE role = 'assistant' AND coalesce(text, '') <> '' GROUP BY conv_id""",
)
def q_conversation_transcript(spark, sf):
    """J7."""
    return TR.assistant_transcript(_turns(spark, sf))


def _inputs(spark, sf):
    """The requests' own age group (every fifth has none) and duration (every third), by conversation."""
    c = F.col("conv_id")
    age = F.when(c % 5 < 4, F.element_at(F.array(*map(F.lit, D.AGE_GROUPS)), (c % 5 + 1).cast("int")))
    return D.table(spark, sf, "conversations").select("conv_id").distinct().select(
        "conv_id", age.alias("patient_age_group"), F.when(c % 3 == 0, (c % 100).cast("int")).alias("duration_hours"))


def _decisions(spark, sf):
    return TR.score_conversations(_turns(spark, sf), _inputs(spark, sf))


SQL_DECISIONS = OT.triage_scored(
    f"""(SELECT *, CASE WHEN conv_id % 5 < 4 THEN {OT.lits(D.AGE_GROUPS)}[CAST(conv_id % 5 + 1 AS INTEGER)] END AS own_age,
      CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id % 100 AS INTEGER) END AS own_hours FROM (""" + SQL_USER_TEXT + ") _u) _ut WHERE user_text <> ''",
    "conv_id", "user_text", "own_age", "own_hours")


@register("conversation_decisions", "SELECT * FROM (" + SQL_DECISIONS + ") _d")
def q_conversation_decisions(spark, sf):
    """The scored triage of every conversation's user text, with the request's own age group and duration."""
    return _decisions(spark, sf)


@register(
    "conversation_history",
    f"""SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT d.conv_id, m.last_turn + 1 AS turn, 'assistant' AS role, d.reasoning_summary AS text
  FROM ({SQL_DECISIONS}) d JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) m ON d.conv_id = m.conv_id""",
)
def q_conversation_history(spark, sf):
    """Every history with the scored reply appended."""
    turns = _turns(spark, sf)
    return TR.history_append(turns, _decisions(spark, sf))


# --------------------------------------------------------------------------- J5, J6, G4
# The decision as JSON text: all keys, or (by conversation) a level beyond five, a missing and an extra key, two values
# outside their enums, two outside their ranges.
_TEXT_KEYS = [k for k in TS.L.EXPECTED_KEYS if k in TS.L.OUTPUT_ENUMS or k in ("primary_symptom", "reasoning_summary")]
_LIST_KEYS = ["severity_indicators", "emergency_flags"]
_ODD = {3: {"provisional_ctas_level": "provisional_ctas_level + 5"}, 5: {"reasoning_summary": None}, 6: {"language": "'xx'", "risk_band": "'none'"},
        7: {"duration_hours": "-1", "risk_score": "101"}}


def _json_sql(changes: dict, array_to_text: str, quote) -> str:
    """SQL (for either engine) of the JSON text; ``array_to_text``: the function that joins an array."""
    parts = []
    for k in TS.L.EXPECTED_KEYS:
        v = changes.get(k, k)
        if v is None:
            parts.append(quote('"note": "more"'))
        elif k in _TEXT_KEYS:
            parts.append(f"""{quote(f'"{k}": "')} || {v} || '"'""")
        elif k in _LIST_KEYS:
            parts.append(f"""{quote(f'"{k}": [')} || CASE WHEN {'size' if array_to_text == 'array_join' else 'len'}({v}) > 0 THEN '"' || {array_to_text}({v}, '", "') || '"' ELSE '' END || ']'""")
        else:
            parts.append(f"""{quote(f'"{k}": ')} || lower(CAST({v} AS {'STRING' if array_to_text == 'array_join' else 'VARCHAR'}))""")
    return "('{' || " + " || ', ' || ".join(parts) + " || '}')"


def _reply_sql(array_to_text: str, line: str, quote) -> str:
    full = _json_sql({}, array_to_text, quote)
    arms = " ".join(f"WHEN conv_id % 8 = {v} THEN '  ' || {_json_sql(c, array_to_text, quote)}" for v, c in _ODD.items())
    return f"""CASE {arms} WHEN conv_id % 8 = 1 THEN 'Assessment follows:' || {line} || {full} || {line} || 'End of assessment.'
      WHEN conv_id % 8 = 2 THEN 'Assessment: ' || substring({full}, 1, 30) ELSE {full} END"""


_T = _strip("coalesce(reply, '')")
_SPAN = f"regexp_extract({_T}, '(?s)(\\{{.*\\}})', 1)"


def _is_obj(x: str) -> str:
    return f"(json_valid({x}) AND {x} <> '' AND json_type({x}) = 'OBJECT')"


def _value(k: str) -> str:
    return f"json_extract_string(payload, '$.{k}')"


def _wrong(k: str, ok: str, kind: str) -> str:
    return f"CASE WHEN list_contains(json_keys(payload), '{k}') AND NOT coalesce({ok}, false) THEN '{kind}:{k}' END"


def _whole(k: str) -> str:
    return f"CASE WHEN regexp_matches({_value(k)}, '^-?[0-9]+$') THEN TRY_CAST({_value(k)} AS BIGINT) END"


_CHECKS = ", ".join([
    *[_wrong(k, f"{_value(k)} IN ({', '.join(OT.q(x) for x in v)})", "enum") for k, v in TS.L.OUTPUT_ENUMS.items()],
    _wrong("provisional_ctas_level", f"{_value('provisional_ctas_level')} IN ('1', '2', '3', '4', '5')", "enum"),
    _wrong("duration_hours", f"{_whole('duration_hours')} >= 0", "range"),
    _wrong("risk_score", f"{_whole('risk_score')} BETWEEN 0 AND 100", "range"),
])
_KEYS = OT.lits(TS.L.EXPECTED_KEYS)
SQL_PAYLOADS = f"""
  SELECT conv_id, payload, payload IS NOT NULL AS accepted, CAST({_value('provisional_ctas_level')} AS INTEGER) AS parsed_ctas_level,
    CASE WHEN payload IS NULL THEN NULL ELSE list_sort(list_concat(list_concat(
      list_transform(list_filter({_KEYS}, lambda k: NOT list_contains(json_keys(payload), k)), lambda k: 'missing:' || k),
      list_transform(list_filter(json_keys(payload), lambda k: NOT list_contains({_KEYS}, k)), lambda k: 'extra:' || k)),
      list_filter([{_CHECKS}], lambda x: x IS NOT NULL))) END AS violations
  FROM (SELECT conv_id, CASE WHEN {_is_obj(_T)} THEN {_T} WHEN {_is_obj(_SPAN)} THEN {_SPAN} END AS payload
        FROM (SELECT conv_id, {_reply_sql("array_to_string", "chr(10)", OT.q)} AS reply FROM ({SQL_DECISIONS}) _d) _r) _p"""


def _replies(spark, sf):
    """Each conversation's decision as reply text."""
    reply = F.expr(_reply_sql("array_join", "char(10)", OT.q))
    return _decisions(spark, sf).select("conv_id", reply.alias("reply"))


@register("decision_payloads", "SELECT * FROM (" + SQL_PAYLOADS + ") _q")
def q_decision_payloads(spark, sf):
    """J5 + J6 + G4: each conversation's decision as reply text, extracted back as JSON and validated over all 16 keys."""
    p = TR.judge_replies(_replies(spark, sf))
    return p.select(
        "conv_id", "payload", F.col("payload").isNotNull().alias("accepted"),
        F.get_json_object("payload", "$.provisional_ctas_level").cast("int").alias("parsed_ctas_level"), "violations",
    )


@register("decision_rejects", f"""
  SELECT conv_id, payload, violations, CASE WHEN payload IS NULL THEN 'unreadable' ELSE 'bad' END AS verdict
  FROM ({SQL_PAYLOADS}) _q WHERE payload IS NULL OR len(violations) > 0""")
def q_decision_rejects(spark, sf):
    """J5 + J6 reject table: replies without a JSON object or in violation of the contract, read from the split table."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/decisions-{uuid.uuid4().hex[:12]}"
    TR.write_by_verdict(TR.judge_replies(_replies(spark, sf)).select("conv_id", "payload", "violations", "verdict"), path)
    return spark.read.parquet(path).filter(F.col("verdict") != TR.GOOD)
