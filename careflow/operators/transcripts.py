"""Conversation operators over a transcript table (conv_id, turn, role, text): J1-J8, G4.

Every operator is a grouped aggregate keyed by conversation. First/last
lookups use ``min_by``/``max_by``, which aggregate partially before the
shuffle, so a conversation with a huge number of turns is reduced map-side.
Only the operators whose *output* is the whole ordered text of a conversation
(J1, J7) gather that conversation's texts, and they gather only the kept
turns' text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.functions import triage_scored as TS

# Python's str.strip() whitespace, written out for Java regex (same text works in RE2).
PY_WS = r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
REPLY_HIDDEN_PREFIX = "<name>"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PY_WS}+|{PY_WS}+$", "")


def _ordered_texts(turns: DataFrame, keep: Column, text: Column) -> DataFrame:
    kept = turns.filter(keep).select("conv_id", F.struct(F.col("turn"), text.alias("t")).alias("_p"))
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("_p")).alias("_parts"))


def user_text(turns: DataFrame) -> DataFrame:
    """All non-empty user turns, each stripped, joined by one space, stripped again."""
    g = _ordered_texts(turns, (F.col("role") == "user") & (F.coalesce(F.col("text"), F.lit("")) != ""), F.col("text"))
    joined = F.array_join(F.transform("_parts", lambda p: py_strip(p["t"])), " ")
    return g.select("conv_id", py_strip(joined).alias("user_text"))


def first_user_text(turns: DataFrame) -> DataFrame:
    """Text of the first user turn of every conversation ('' when it has none)."""
    is_user = F.col("role") == "user"
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.min_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))), F.lit("")).alias("first_user_text")
    )


def last_assistant_text(turns: DataFrame) -> DataFrame:
    """Last assistant turn whose stripped text is non-empty and not a hidden name tag; '' when none."""
    s = py_strip(F.coalesce(F.col("text"), F.lit("")))
    ok = (F.col("role") == "assistant") & (s != "") & ~s.startswith(REPLY_HIDDEN_PREFIX)
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max_by(F.when(ok, s), F.when(ok, F.col("turn"))), F.lit("")).alias("last_reply")
    )


def assistant_transcript(turns: DataFrame) -> DataFrame:
    """The non-empty assistant texts of a conversation in turn order, joined by newlines."""
    g = _ordered_texts(turns, (F.col("role") == "assistant") & (F.coalesce(F.col("text"), F.lit("")) != ""), F.col("text"))
    return g.select("conv_id", F.array_join(F.transform("_parts", lambda p: p["t"]), "\n").alias("assistant_text"))


def score_conversations(turns: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """J1 then the scored triage (H34) for every conversation with user text.

    ``inputs`` (conv_id, patient_age_group, duration_hours; one row per conversation at most) are the request's own
    age group and duration, which come before what the text says."""
    ut = user_text(turns).filter(F.col("user_text") != "")
    if inputs is None:
        return TS.triage_scored(ut, "user_text", None, None).select("conv_id", *TS.DECISION_COLUMNS)
    own = inputs.select("conv_id", F.col("patient_age_group").alias("_age"), F.col("duration_hours").alias("_hours"))
    return TS.triage_scored(ut.join(own, "conv_id", "left"), "user_text", "_age", "_hours").select("conv_id", *TS.DECISION_COLUMNS)


def history_append(turns: DataFrame, replies: DataFrame, reply_col: str = "reasoning_summary") -> DataFrame:
    """History plus one assistant reply per conversation, at the turn after its last one."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    add = replies.join(last, "conv_id").select(
        "conv_id", (F.col("_last") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col(reply_col).alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(add)


# --------------------------------------------------------------------------- J5, J6
def extract_json(text: Column) -> Column:
    """The text when it is a JSON object, else its greedy '{...}' span when that is one, else NULL."""
    t = py_strip(F.coalesce(text, F.lit("")))
    span = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(F.json_object_keys(t).isNotNull(), t).when(F.json_object_keys(span).isNotNull(), span)


def validate_payload(payload: Column) -> Column:
    """J6 + G4: sorted violations of a payload: missing and extra keys, values outside the seven enums and the level's,
    and the two whole-number ranges; empty when valid."""
    text = F.array().cast("array<string>")
    keys, expected = F.coalesce(F.json_object_keys(payload), text), F.array(*[F.lit(k) for k in L.EXPECTED_KEYS])
    named = lambda kind, ks: F.transform(ks, lambda k: F.concat(F.lit(kind + ":"), k))
    value = lambda k: F.get_json_object(payload, f"$.{k}")
    wrong = lambda k, ok: F.array_contains(keys, k) & ~F.coalesce(ok, F.lit(False))
    whole = lambda k: F.when(value(k).rlike(r"^-?[0-9]+$"), value(k).try_cast("long"))
    checks = [F.when(wrong(k, value(k).isin(*allowed)), F.lit(f"enum:{k}")) for k, allowed in L.OUTPUT_ENUMS.items()]
    checks.append(F.when(wrong("provisional_ctas_level", value("provisional_ctas_level").isin(*map(str, L.CTAS_LABELS))), F.lit("enum:provisional_ctas_level")))
    checks.append(F.when(wrong("duration_hours", whole("duration_hours") >= 0), F.lit("range:duration_hours")))
    checks.append(F.when(wrong("risk_score", whole("risk_score").between(0, 100)), F.lit("range:risk_score")))
    return F.array_sort(F.concat(named("missing", F.array_except(expected, keys)), named("extra", F.array_except(keys, expected)), F.array_compact(F.array(*checks))))


GOOD, BAD, UNREADABLE = "good", "bad", "unreadable"


def judge_replies(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """J5 + J6: every reply with its payload, violations and verdict: good, bad (readable but in violation of the
    contract) or unreadable (no JSON object in it)."""
    found = replies.withColumn("payload", extract_json(F.col(reply_col)))
    found = found.withColumn("violations", F.when(F.col("payload").isNotNull(), validate_payload(F.col("payload"))))
    return found.withColumn("verdict", F.when(F.col("payload").isNull(), UNREADABLE).when(F.size("violations") > 0, BAD).otherwise(GOOD))


def write_by_verdict(judged: DataFrame, path: str) -> dict[str, int]:
    """Good rows and rejects (G4's table of bad payloads) in one write, partitioned by verdict, so that readers of either
    read no file of the other; the counts come out of the same pass."""
    seen = Observation(f"verdicts-{uuid.uuid4().hex[:12]}")
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in (GOOD, BAD, UNREADABLE)]
    judged.observe(seen, *counts).write.mode("overwrite").partitionBy("verdict").parquet(path)
    return dict(seen.get)
