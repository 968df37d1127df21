"""Queries on turns' contexts. Events stand for atoms: views reply, clicks are token signals, purchases call tools, signups are results,
errors name models or are system messages; a user is a session and a month a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators import turn_context as TC
from turnloom.plans.registry import query, table


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id")
    is_reply, is_signal = kind == "view", kind == "click"

    def name(prefix: str, n) -> F.Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    def counts(n, out) -> F.Column:
        return F.struct(*((n if c == "input_tokens" else out if c == "output_tokens" else n + F.coalesce(out, F.lit(0)) if c == "total_tokens" else F.lit(None)).cast("long").alias(c) for c in TC.COUNTS), F.lit(None).cast("string").alias("model"))

    return table(spark, sf_dir, "events").select(
        user.alias("session"),
        F.date_format("ts", "yyyy-MM").alias("turn"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq_no"),
        key.alias("id"),
        F.when(is_reply, "text").when(is_signal, "token_usage_signal").when(kind == "purchase", "tool_call").when(kind == "signup", "tool_result").when(key % 2 == 0, "model_signal").otherwise("text").alias("kind"),
        F.when(is_reply, "assistant").otherwise("system").alias("actor_kind"),
        F.when(is_reply | (kind == "error"), F.concat(F.lit("said "), key.cast("string"))).alias("text"),
        F.when(is_reply & (key % 3 > 0) | is_signal & (key % 4 > 0), name("m", key % 7)).alias("message_id"),
        F.when(is_reply & (key % 5 == 0) | (kind == "error"), name("model", key % 4)).alias("model"),
        F.when(kind.isin("purchase", "signup"), name("c", key % 5)).alias("call_id"),
        F.when(kind == "purchase", F.lit("AskUserQuestion")).alias("tool_name"),
        F.when(kind == "purchase", F.concat(F.lit('{"questions":[{"question":"Which?","options":[{"label":"A'), (key % 3).cast("string"), F.lit('"},{"label":"B"}]}]}'))).alias("input"),
        F.when(kind == "signup", F.when(key % 2 == 0, name("a", key % 3)).otherwise(F.concat(F.lit('Your questions have been answered: "Which?"="'), name("b", key % 2), F.lit('"')))).alias("output"),
        F.when(is_signal, counts(key % 100, F.when(key % 2 == 0, key % 10))).alias("usage"),
        F.when(is_signal & (user % 3 == 1) & (key % 2 == 0), counts(key % 50, key % 3)).alias("delta"),
        F.when(is_signal & (user % 3 == 0), "token_count").alias("source_event_type"),
        F.when(is_reply & (key % 11 == 0), "error").when(is_signal, "end_turn").alias("stop_reason"),
    )


ATOMS = """
e AS (SELECT *, strftime(ts, '%Y-%m') AS turn, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM events
), r AS (
  SELECT user_id, turn, event_id, q, CASE WHEN event_id % 3 > 0 THEN event_id % 7 END AS m, row_number() OVER (PARTITION BY user_id, turn ORDER BY q) AS n FROM e WHERE event_type = 'view'
), g AS (
  SELECT user_id, turn, event_id, q, CASE WHEN event_id % 4 > 0 THEN event_id % 7 END AS m FROM e WHERE event_type = 'click'
), s AS (
  SELECT g.*, CASE WHEN m IS NULL THEN (SELECT max(n) FROM r WHERE r.user_id = g.user_id AND r.turn = g.turn AND r.q < g.q)
    ELSE (SELECT max(n) FROM r WHERE r.user_id = g.user_id AND r.turn = g.turn AND r.q < g.q AND r.m = g.m) END AS known,
    (SELECT min(n) FROM r WHERE r.user_id = g.user_id AND r.turn = g.turn AND r.q > g.q) AS following, (SELECT max(n) FROM r WHERE r.user_id = g.user_id AND r.turn = g.turn) AS last
  FROM g
), a AS (SELECT *, coalesce(known, following, last) AS reply, known IS NULL AND following IS NULL AS trails FROM s
)"""


@query("signal_attribution", f"WITH {ATOMS} SELECT a.event_id AS signal, a.reply, r.event_id AS reply_event FROM a LEFT JOIN r ON r.user_id = a.user_id AND r.turn = a.turn AND r.n = a.reply")
def _signals(spark, sf_dir):
    own = atoms(spark, sf_dir)
    said = TC.replies(own).select("session", "turn", "reply", F.col("id").alias("reply_event"))
    return TC.attribute_signals(own).join(said, ["session", "turn", "reply"], "left").select(F.col("id").alias("signal"), "reply", "reply_event")


BILLS = f"""{ATOMS}, u AS (
  SELECT user_id, turn, reply, event_id, event_id % 100 AS i, CASE WHEN event_id % 2 = 0 THEN event_id % 10 END AS o, user_id % 3 = 1 AND event_id % 2 = 0 AS grows, trails, q FROM a WHERE reply IS NOT NULL
), b AS (
  SELECT user_id, turn, reply, bool_or(grows) AS grew, count(*) AS k, sum(event_id % 50) FILTER (grows) AS gi, sum(event_id % 3) FILTER (grows) AS go,
    arg_max(i, struct_pack(t := trails, q := q)) AS li, arg_max(struct_pack(o := o), struct_pack(t := trails, q := q)).o AS lo, sum(i) AS si, sum(o) AS so FROM u GROUP BY 1, 2, 3
), w AS (
  SELECT *, CASE WHEN grew THEN gi WHEN user_id % 3 = 0 THEN li ELSE si END AS input_tokens, CASE WHEN grew THEN go WHEN user_id % 3 = 0 THEN lo WHEN k > 1 THEN coalesce(so, 0) ELSE so END AS output_tokens FROM b
), named AS (
  SELECT user_id, turn, q, event_type, event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 OR event_type = 'view' AND event_id % 5 = 0 THEN 'model' || event_id % 4 END AS model FROM e
), carried AS (SELECT *, last_value(model IGNORE NULLS) OVER (PARTITION BY user_id, turn ORDER BY q) AS active FROM named
), x AS (
  SELECT r.user_id, r.turn, r.event_id, r.n AS reply, coalesce(c.active, 'unknown') AS model, w.input_tokens::BIGINT AS input_tokens, w.output_tokens::BIGINT AS output_tokens,
    (w.input_tokens + coalesce(w.output_tokens, 0))::BIGINT AS token_count, CASE WHEN r.event_id % 11 = 0 THEN 'error' WHEN w.reply IS NOT NULL THEN 'end_turn' END AS stop_reason
  FROM r JOIN carried c USING (event_id) LEFT JOIN w ON w.user_id = r.user_id AND w.turn = r.turn AND w.reply = r.n
)"""


@query("reply_usage", f"WITH {BILLS} SELECT event_id AS id, reply, model, input_tokens, output_tokens, token_count, stop_reason FROM x")
def _replies(spark, sf_dir):
    return TC.replies(atoms(spark, sf_dir)).select("id", "reply", "model", "usage.input_tokens", "usage.output_tokens", "token_count", "stop_reason")


CALLS = """
calls AS (SELECT * FROM e WHERE event_type = 'purchase'
), results AS (
  SELECT o.*, (SELECT max(struct_pack(q := c.q, id := c.event_id)) FROM calls c WHERE c.user_id = o.user_id AND c.event_id % 5 = o.event_id % 5 AND c.q < o.q) AS of_call,
    CASE WHEN o.event_id % 2 = 0 THEN 'a' || o.event_id % 3 ELSE 'Your questions have been answered: "Which?"="b1"' END AS output
  FROM e o WHERE event_type = 'signup'
), edges AS (SELECT event_id, user_id, turn, q, ts, output, of_call.id AS call FROM results WHERE of_call IS NOT NULL
)"""


@query("tool_result_edges", f"WITH {ATOMS}, {CALLS} SELECT event_id AS result_id, call FROM edges")
def _edges(spark, sf_dir):
    return TC.result_edges(atoms(spark, sf_dir)).select("result_id", "call")


@query(
    "turn_context",
    f"""WITH {BILLS}, {CALLS}, firsts AS (SELECT call, arg_min(struct_pack(turn := turn, output := output), q) AS f FROM edges GROUP BY 1
), last_reply AS (SELECT user_id, turn, arg_max(event_id, n) AS id FROM r GROUP BY 1, 2
), c AS (
  SELECT calls.user_id, calls.turn, calls.event_id, calls.q, coalesce((SELECT CASE WHEN max(struct_pack(q := v.q, t := v.turn, id := v.event_id)).t = calls.turn THEN max(struct_pack(q := v.q, t := v.turn, id := v.event_id)).id END FROM e v WHERE v.event_type = 'view' AND v.user_id = calls.user_id AND v.q < calls.q), l.id) AS reply,
    CASE WHEN f.turn = calls.turn THEN f.output END AS output
  FROM calls LEFT JOIN firsts ON call = calls.event_id LEFT JOIN last_reply l ON l.user_id = calls.user_id AND l.turn = calls.turn
), cc AS (SELECT user_id, turn, count(*) AS call_count, sha256(string_agg(event_id || '/' || coalesce(reply::VARCHAR, '-') || '/' || coalesce(output, '-'), chr(10) ORDER BY q)) AS calls_sha FROM c GROUP BY 1, 2
), rr AS (SELECT user_id, turn, count(*) AS reply_count, arg_min(model, reply) AS primary_model, bool_or(stop_reason IS NOT DISTINCT FROM 'error') AS has_errors,
  CASE WHEN count(input_tokens) > 0 THEN coalesce(sum(token_count), 0) END::BIGINT AS total_tokens FROM x GROUP BY 1, 2
), mm AS (SELECT user_id, turn, count(*) AS messages FROM e WHERE event_type = 'error' AND event_id % 2 = 1 GROUP BY 1, 2
), t AS (SELECT DISTINCT user_id, turn FROM e)
SELECT t.user_id AS session, t.turn, coalesce(reply_count, 0) AS reply_count, primary_model, coalesce(has_errors, false) AS has_errors, total_tokens, coalesce(call_count, 0) AS call_count, calls_sha, coalesce(messages, 0) AS messages,
  CASE WHEN reply_count IS NULL THEN 'no_assistant_reply' END AS zero_token_reason
FROM t LEFT JOIN rr USING (user_id, turn) LEFT JOIN cc USING (user_id, turn) LEFT JOIN mm USING (user_id, turn)""",
)
def _turn_context(spark, sf_dir):
    out = TC.turn_context(atoms(spark, sf_dir), previews=False)
    line = F.transform("calls", lambda c: F.concat_ws("/", c["id"].cast("string"), F.coalesce(c["reply_id"].cast("string"), F.lit("-")), F.coalesce(c["output"], F.lit("-"))))
    calls = F.when(F.col("call_count") > 0, F.sha2(F.array_join(line, "\n"), 256))
    return out.select("session", "turn", "reply_count", "primary_model", "has_errors", F.col("token_usage.total_tokens").alias("total_tokens"), "call_count", calls.alias("calls_sha"), F.coalesce(F.size("messages"), F.lit(0)).cast("long").alias("messages"), "zero_token_reason")


@query(
    "ask_user_turns",
    f"""WITH {ATOMS}, {CALLS}, lasts AS (SELECT call, arg_max(struct_pack(id := event_id, output := output), q) AS l FROM edges GROUP BY 1
), z AS (SELECT call AS call_id, l.id AS result_id, 'A' || call % 3 AS option, CASE WHEN l.id % 2 = 0 THEN l.output ELSE 'b1' END AS said FROM lasts)
SELECT call_id, result_id, 1 AS questions, option AS first_option, 0 AS question_index, CASE WHEN upper(said) = option THEN option END AS selected_label, CASE WHEN upper(said) <> option THEN said END AS free_text FROM z""",
)
def _asked(spark, sf_dir):
    out = TC.ask_user_turns(atoms(spark, sf_dir), "claude_code")
    return out.select("call_id", "result_id", F.size("questions").cast("long").alias("questions"), F.col("questions")[0]["options"][0]["label"].alias("first_option"), F.explode("answers").alias("a")).select("call_id", "result_id", "questions", "first_option", "a.*")
