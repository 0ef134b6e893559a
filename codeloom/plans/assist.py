"""Prompt, suggestion, trigger and message-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import assist as fa
from codeloom.functions import text as tx
from codeloom.operators import assist
from codeloom.operators import segments as sg
from codeloom.plans.corpus import FILES_CTE, files
from codeloom.plans.registry import query
from codeloom.plans.segments import LINES, lint_sql
from codeloom.plans.views import REPLIES_SQL, REQUESTS_SQL, replies, requests, table

FENCE = fa.FENCE


def any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def class_sql(text: str, classes: dict[str, list[str]]) -> str:
    whens = " ".join(f"WHEN {any_sql(text, words)} THEN '{name}'" for name, words in classes.items())
    return f"CASE {whens} ELSE 'other' END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# A message with code context on two turns out of three.
TURNS_SQL = "SELECT conv_id, turn, text AS message, CASE WHEN turn % 3 = 0 THEN '' ELSE concat(role, chr(10), text) END AS context, role AS language FROM conversations"
NL = "chr(10)"
PROMPT_SQL = {
    "chat": f"""concat('User: ', message, {NL}, CASE WHEN context <> '' THEN concat('Code Context:', {NL}, '```', {NL}, context, {NL}, '```', {NL}) ELSE '' END, 'Assistant:')""",
    "local_chat": f"""concat(CASE WHEN context <> '' THEN concat('Code context:', {NL}, context, {NL}, {NL}) ELSE '' END,
        'You are a helpful programming assistant.', {NL}, {NL}, 'User: ', message, {NL}, 'Assistant:')""",
    "messages": f"""concat('system=', {quoted(fa.HELP_SYSTEM.format(name="a code helper"))}, ';',
        CASE WHEN context <> '' THEN concat('system=Code context:', {NL}, '```', {NL}, context, {NL}, '```;') ELSE '' END, 'user=', message)""",
    "completion": f"""concat('system=', {quoted(fa.COMPLETION_SYSTEM)}, ';user=You are an expert ', language, ' programmer. Complete the following code with 3 different suggestions.', {NL},
        'Only return the completion code without explanations.', {NL}, {NL}, 'Code to complete:', {NL}, '```', language, {NL}, message, {NL}, '```', {NL}, {NL},
        'Complete this code with the most likely continuation:')""",
    "local_completion": f"concat('Complete this ', language, ' code:', {NL}, message)",
    "hub_completion": f"concat('# ', language, ' code completion', {NL}, message)",
    "explain": f"concat('Please explain this ', language, ' code:', {NL}, {NL}, '```', language, {NL}, message, {NL}, '```')",
    "fix": f"""concat('I''m getting this error: "', context, '"', {NL}, {NL}, 'In this ', language, ' code:', {NL}, {NL}, '```', language, {NL}, message, {NL}, '```', {NL}, {NL}, 'Can you help me fix it?')""",
    "explain_error": f"""concat('Can you explain this ', language, ' error: "', context, '"', {NL}, {NL}, 'Code: ', message)""",
}


@query(f"SELECT conv_id, turn, {', '.join(f'md5({sql}) AS {name}' for name, sql in PROMPT_SQL.items())} FROM ({TURNS_SQL})")
def build_chat_prompt(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "text AS message", "CASE WHEN turn % 3 = 0 THEN '' ELSE concat(role, chr(10), text) END AS context", "role AS language"
    )
    message, context, language = F.col("message"), F.col("context"), F.col("language")

    def flat(messages):
        return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"])), ";")

    prompts = {
        "chat": fa.chat_prompt(message, context),
        "local_chat": fa.local_chat_prompt(message, context),
        "messages": flat(fa.chat_messages(message, context)),
        "completion": flat(fa.completion_messages(message, language, F.lit(3))),
        "local_completion": fa.local_completion_prompt(message, language),
        "hub_completion": fa.hub_completion_prompt(message, language),
        "explain": fa.explain_message(message, language),
        "fix": fa.fix_message(message, context, language),
        "explain_error": fa.explain_error_message(message, context, language),
    }
    return turns.select("conv_id", "turn", *[F.md5(p).alias(name) for name, p in prompts.items()])


@query(f"""SELECT conv_id, turn, md5(trim(concat(chr(10), ' ', text, ' ', chr(9)), '{tx.BLANK}')) AS digest FROM conversations""")
def strip_prompt(spark, sf_dir):
    outputs = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "concat(role, ':') AS prompt", "concat(role, ':', chr(10), ' ', text, ' ', chr(9)) AS output"
    )
    return outputs.select("conv_id", "turn", F.md5(fa.strip_prompt(F.col("output"), F.col("prompt"))).alias("digest"))


ANSWERS = """CASE doc_id % 4 WHEN 0 THEN concat('Sure:', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'Done.')
      WHEN 1 THEN concat('```', text, '```') WHEN 2 THEN concat(' ', text, chr(10)) ELSE concat('```js', chr(10), text) END"""


@query(
    f"""SELECT doc_id, md5(CASE WHEN t IS NULL THEN trim(a, '{tx.BLANK}') WHEN starts_with(t, 'python') THEN trim(t[7:], '{tx.BLANK}') ELSE t END) AS digest
      FROM (SELECT doc_id, a, trim(string_split(a, '```')[2], '{tx.BLANK}') AS t FROM (SELECT doc_id, {ANSWERS} AS a FROM documents))"""
)
def clean_fenced(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{ANSWERS} AS answer")
    return answers.select("doc_id", F.md5(fa.clean_fenced(F.col("answer"), F.lit("python"))).alias("digest"))


SUGGESTIONS = """CASE doc_id % 5 WHEN 0 THEN concat('```python', chr(10), text, chr(10), '```') WHEN 1 THEN concat(' ```', text, '``` ')
      WHEN 2 THEN concat(' ', text, chr(10)) WHEN 3 THEN concat('``````javascript', chr(10), text) ELSE concat('```typescript', text, '```') END"""
_TRIM_JS = f"trim({{}}, '{tx.BLANK_JS}')"


def _untagged_sql(text: str, marks: list[str]) -> str:
    out = _TRIM_JS.format(text)
    for mark in marks:
        out = _TRIM_JS.format(f"regexp_replace({out}, '{mark}', '')")
    return out


@query(
    f"""SELECT doc_id, md5({_untagged_sql('s', ['^```(python|javascript|typescript)?', '```$'])}) AS digest,
        md5({_untagged_sql('s', ['^```', '^```python', '^```javascript', '^```typescript', '```$'])}) AS strict_digest
      FROM (SELECT doc_id, {SUGGESTIONS} AS s FROM documents)"""
)
def clean_suggestion(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SUGGESTIONS} AS s")
    return raw.select(
        "doc_id",
        F.md5(fa.clean_suggestion(F.col("s"))).alias("digest"),
        F.md5(fa.clean_suggestion(F.col("s"), strict_compat=True)).alias("strict_digest"),
    )


@query(
    """SELECT conv_id, turn, rank, round(0.9::double - rank * 0.1::double, 6) AS custom, round(0.85::double + rank * 0.05::double, 6) AS remote,
        round(0.8::double - rank * 0.1::double, 6) AS local, round(0.75::double - rank * 0.1::double, 6) AS hub
      FROM (SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS rank FROM conversations)"""
)
def rank_confidence(spark, sf_dir):
    ranks = tx.unnest(table(spark, sf_dir, "conversations"), tx.lines(F.col("text")), "conv_id", "turn", pos="rank")
    return ranks.select("conv_id", "turn", "rank", *[F.round(fa.rank_confidence(F.col("rank"), k), 6).alias(k) for k in fa.CONFIDENCE_STEPS])


@query(
    """SELECT doc_id, md5(array_to_string(list_concat(l, ['', '', ''])[1:3], '|')) AS padded,
        md5(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i])[1:3], '|')) AS different
      FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)"""
)
def pad_suggestions(spark, sf_dir):
    lines = tx.lines(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(F.array_join(fa.pad_suggestions(lines, 3), "|")).alias("padded"),
        F.md5(F.array_join(fa.first_distinct(lines, 3), "|")).alias("different"),
    )


@query(f"{FILES_CTE} SELECT doc_id, {class_sql('l[-1]', fa.LINE_WORDS)} AS context FROM (SELECT doc_id, {LINES} AS l FROM (SELECT doc_id, trim(text, chr(10)) AS text FROM files))")
def last_line_context(spark, sf_dir):
    cut = files(spark, sf_dir).withColumn("text", F.btrim("text", F.lit("\n")))
    return cut.select("doc_id", fa.line_context(F.col("text")).alias("context"))


@query(f"SELECT conv_id, turn, {class_sql('lower(text)', fa.INTENT_WORDS)} AS intent FROM conversations")
def chat_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fa.chat_intent(F.col("text")).alias("intent"))


@query(
    f"""SELECT doc_id, md5(array_to_string(l[greatest(0, pos - 50) + 1:least(n - 1, pos + 50) + 1], chr(10))) AS wide,
        md5(array_to_string(l[greatest(0, pos - 10) + 1:least(n - 1, pos + 10) + 1], chr(10))) AS narrow
      FROM (SELECT doc_id, {LINES} AS l, len({LINES}) AS n, doc_id % len({LINES}) AS pos FROM documents)"""
)
def cursor_context(spark, sf_dir):
    text = F.col("text")
    line = (F.col("doc_id") % tx.line_count(text)).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(fa.cursor_context(text, line)).alias("wide"),
        F.md5(fa.cursor_context(text, line, around=10)).alias("narrow"),
    )


def _sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _odd_sql(mark: str) -> str:
    return f"len(regexp_extract_all(p, {mark})) % 2 = 1"


@query(
    f"""{FILES_CTE}, lined AS (SELECT doc_id, language, unnest(range(len({LINES}))) AS line, unnest({LINES}) AS t FROM files),
      cursors AS (SELECT *, doc_id % 23 AS col, t[1:doc_id % 23] AS p FROM lined)
      SELECT doc_id, line, language IN {_sql_list(fa.SUPPORTED)} AND NOT (line = 0 AND col < 2)
        AND NOT ((language IN {_sql_list(fa.HASH_COMMENTS)} AND contains(p, '#'))
          OR (language IN {_sql_list(fa.SLASH_COMMENTS)} AND (contains(p, '//') OR regexp_matches(p, '/\\*[\\s\\S]*?\\*/'))))
        AND NOT ({_odd_sql("''''")} OR {_odd_sql("chr(34)")} OR {_odd_sql("'`'")})
        AND length(trim(p, '{tx.BLANK_JS}')) >= 2 AS trigger FROM cursors"""
)
def should_trigger(spark, sf_dir):
    """Every line of every file, with the cursor at a column that depends on the file."""
    lined = tx.unnest(files(spark, sf_dir), tx.lines(F.col("text")), "doc_id", "language", pos="line", item="t")
    column = (F.col("doc_id") % 23).cast("int")
    return lined.select("doc_id", "line", fa.should_trigger(F.col("t"), F.col("line"), column, F.col("language")).alias("trigger"))


SHOWN_SCORE = "(conv_id * 7 + turn * 3 + {i} * 11) % 100 / 100.0"


@query(
    f"""WITH raw AS (SELECT conv_id, turn, unnest(range(len({LINES}))) AS i, len({LINES}) AS n, concat('```python ', unnest({LINES}), '```') AS s FROM conversations),
      scored AS (SELECT conv_id, turn, i, {_untagged_sql('s', ['^```(python|javascript|typescript)?', '```$'])} AS t,
        CASE WHEN i < n - 1 THEN ((conv_id * 7 + turn * 3 + i * 11) % 100)::double / 100 ELSE 0 END AS c FROM raw),
      placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS place FROM scored WHERE c >= 0.3::double AND t <> '')
      SELECT conv_id, turn, place, md5(t) AS digest, round(c, 6) AS confidence, concat('Suggestion (', CAST(floor(c * 100 + 0.5) AS int), '%)') AS title
      FROM placed WHERE place < 3"""
)
def rank_suggestions(spark, sf_dir):
    """Lines of a turn as suggestions; the last one has no score."""
    turns = table(spark, sf_dir, "conversations").withColumn("_lines", tx.lines(F.col("text")))
    suggestions = F.transform("_lines", lambda line: F.concat(F.lit("```python "), line, F.lit("```")))
    scores = F.transform(
        F.slice(F.col("_lines"), F.lit(1), F.size("_lines") - 1),
        lambda _, i: ((F.col("conv_id") * 7 + F.col("turn") * 3 + i * 11) % 100).cast("double") / 100,
    )
    shown = turns.select("conv_id", "turn", suggestions.alias("s"), scores.alias("c"))
    ranked = tx.unnest(shown, assist.ranked_suggestions(F.col("s"), F.col("c")), "conv_id", "turn", pos="place", item="r")
    return ranked.select("conv_id", "turn", "place", F.md5("r.text").alias("digest"), F.round("r.confidence", 6).alias("confidence"), "r.title")


MESSAGES = """concat(CASE doc_id % 6 WHEN 0 THEN 'IndentationError: ' WHEN 1 THEN 'ReferenceError ' WHEN 2 THEN 'SyntaxError, TypeError '
      WHEN 3 THEN 'Cannot read property of ' WHEN 4 THEN 'Property does not exist on ' ELSE '' END, text)"""
MESSAGE_LANGUAGE = "CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' ELSE 'go' END"


def tips_sql() -> str:
    whens = [
        f"WHEN language = '{language}' AND contains(lower(message), '{pattern}') THEN {quoted(tip)}"
        for language, tips in fa.ERROR_TIPS.items()
        for pattern, tip in tips.items()
    ]
    return f"CASE {' '.join(whens)} END"


@query(f"SELECT doc_id, {tips_sql()} AS tip FROM (SELECT doc_id, {MESSAGES} AS message, {MESSAGE_LANGUAGE} AS language FROM documents)")
def error_tips(spark, sf_dir):
    errors = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{MESSAGES} AS message", f"{MESSAGE_LANGUAGE} AS language")
    return errors.select("doc_id", fa.error_tip(F.col("message"), F.col("language")).alias("tip"))


@query(
    f"""{lint_sql()}, cursors AS (SELECT doc_id, line_no AS line, doc_id % 20 AS col FROM lined)
      SELECT doc_id, line AS position_id, code, severity, message, CASE severity WHEN 2 THEN 'ℹ️ Info' WHEN 3 THEN '💡 Hint' END AS label
      FROM (SELECT doc_id, line, code, severity, message, row_number() OVER (PARTITION BY doc_id, line ORDER BY rule_no) AS place
        FROM cursors JOIN findings USING (doc_id, line) WHERE col <= width) WHERE place = 1"""
)
def diagnostic_at_position(spark, sf_dir):
    """The first line check that holds at a cursor on every line of every file."""
    code = files(spark, sf_dir)
    findings = sg.lint_lines(code, "doc_id").select(
        "doc_id", F.col("line").alias("start_line"), F.lit(0).alias("start_column"), F.col("line").alias("end_line"),
        F.col("width").alias("end_column"), "rule_no", "code", "severity", "message",
    )
    cursors = tx.unnest(code, tx.lines(F.col("text")), "doc_id", pos="line").select(
        "doc_id", F.col("line").alias("position_id"), "line", (F.col("doc_id") % 20).cast("int").alias("column")
    )
    return assist.findings_at(cursors, findings, "doc_id")


MATCH_CTE = f"""WITH req AS ({REQUESTS_SQL}), rep AS ({REPLIES_SQL}),
    pairs AS (SELECT req.request_id, req.type AS request_type, rep.reply_id, rep.type AS reply_type,
        row_number() OVER (PARTITION BY req.request_id ORDER BY rep.ts, rep.reply_id) AS place
      FROM req JOIN rep ON req.request_id = rep.request_id AND rep.ts >= req.ts
        AND rep.ts < req.ts + CASE WHEN req.type = 'completion_request' THEN INTERVAL 10 SECOND ELSE INTERVAL 15 SECOND END),
    settled AS (SELECT * FROM pairs WHERE place = 1)"""


@query(
    f"""{MATCH_CTE} SELECT req.request_id, type AS request_type, reply_id, CASE WHEN reply_id IS NULL THEN 'timeout'
        WHEN reply_type = replace(type, 'request', 'response') THEN 'answered' ELSE 'rejected' END AS status
      FROM req LEFT JOIN settled ON req.request_id = settled.request_id
      UNION ALL SELECT request_id, NULL, reply_id, 'unknown' FROM rep WHERE reply_id NOT IN (SELECT reply_id FROM settled)"""
)
def request_response_match(spark, sf_dir):
    """Outcome of every request, and the replies nobody waited for."""
    outcomes, unknown = assist.match_replies(requests(spark, sf_dir), replies(spark, sf_dir))
    stray = unknown.select("request_id", F.lit(None).cast("string").alias("request_type"), "reply_id", F.lit("unknown").alias("status"))
    return outcomes.unionByName(stray)
