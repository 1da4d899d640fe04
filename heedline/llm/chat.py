"""Preference formatting of chosen and rejected conversations (operator 4).

The longest common turn prefix of the two sides is rendered once, as the prompt; what follows
on either side is its completion.  A completion comes with the spans that are trained on: the
text and end mark of each assistant turn, as (start, length) in code points of the completion.
All of it is DataFrame functions over the turns inside one row.

A turn is a role and a text; null ones count as empty.  Turns of a conversation are ordered by
number (null first), then role and text, so repeated numbers have a fixed order.  Equal sides
give a prompt and two empty completions; sides without a common turn an empty prompt; a null
side counts as no turns.  Rows without conv_id belong to no conversation and are left out.
Extra columns are ignored; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
ASSISTANT = "assistant"
TURNS = "array<struct<role: string, text: string>>"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def spans(turns: Column) -> Column:
    """(start, length) of what is trained on in ``render(turns)``."""
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("found")
    )

    def step(done: Column, turn: Column) -> Column:
        head = F.lit(len(OPEN) + len(AFTER_ROLE)) + F.length(turn["role"])
        body = F.length(turn["text"]) + len(CLOSE)
        span = F.struct((done["at"] + head).alias("start"), body.alias("length"))
        found = F.when(turn["role"] == ASSISTANT, F.array_append(done["found"], span)).otherwise(done["found"])
        return F.struct((done["at"] + head + body).alias("at"), found.alias("found"))

    return F.aggregate(turns, start, step, lambda done: done["found"])


def common_turns(a: Column, b: Column) -> Column:
    """How many turns from the first on are equal on both sides."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) from single turns (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    row = F.struct("turn", text("role"), text("text"))
    ordered = F.array_sort(F.collect_list(row), _by_turn)
    grouped = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(ordered.alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"], t["text"])))


def _by_turn(a: Column, b: Column) -> Column:
    """Order of turns; a null number comes first."""
    order = F.lit(0)
    for field in ("text", "role", "turn"):
        x, y = a[field], b[field]
        smaller = F.coalesce(x < y, x.isNull() & y.isNotNull())
        larger = F.coalesce(x > y, x.isNotNull() & y.isNull())
        order = F.when(smaller, -1).when(larger, 1).otherwise(order)
    return order


def with_stale_answers(chats: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): as rejected side, the last answer only repeats the one before.

    The conversation then ends there; a first answer is left empty.  A conversation without an
    answer is its own rejected side.
    """
    answers = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("turns"), F.lit(1))),
        lambda i: F.get(F.col("turns"), i - 1)["role"] == ASSISTANT,
    )
    n, last = F.size("answers"), F.get("answers", F.size("answers") - 1)
    former = F.coalesce(F.get("turns", F.get("answers", n - 2) - 1)["text"], F.lit(""))
    stale = F.array(F.struct(F.lit(ASSISTANT).alias("role"), former.alias("text")))
    rejected = F.when(n == 0, F.col("turns")).otherwise(F.concat(F.slice("turns", F.lit(1), last - 1), stale))
    return chats.withColumn("answers", answers).select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def format_preferences(pairs: DataFrame, key: str) -> DataFrame:
    """Prompt, completions and their spans for pairs (``key``, chosen, rejected)."""
    sides = pairs.select(
        key, *[F.coalesce(F.col(s).cast(TURNS), F.array().cast(TURNS)).alias(s) for s in ("chosen", "rejected")]
    ).withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    n = F.col("n_prompt_turns")
    rest = {s: F.slice(s, n + 1, F.size(s)) for s in ("chosen", "rejected")}
    return sides.select(
        key,
        "n_prompt_turns",
        render(F.slice("chosen", F.lit(1), n)).alias("prompt"),
        *[render(rest[s]).alias(s) for s in rest],
        *[spans(rest[s]).alias(f"{s}_spans") for s in rest],
    )


def preference_rows(turns: DataFrame) -> DataFrame:
    """The formatted pairs of all conversations; spans are written as start+length, with commas."""
    done = format_preferences(with_stale_answers(conversations(turns)), "conv_id")
    for side in ("chosen_spans", "rejected_spans"):
        written = F.transform(side, lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string")))
        done = done.withColumn(side, F.array_join(written, ","))
    return done


_RENDER = "list_transform({0}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10))"
_SPANS = """array_to_string(list_transform(
    list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'),
    lambda i: (coalesce(list_sum(list_transform({0}[1:i - 1], lambda t: 24 + length(t.role) + length(t.text))), 0)
          + 22)::INT::VARCHAR || '+' || (length({0}[i].text) + 11)::VARCHAR), ',')"""

SQL = f"""
WITH chats AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS c
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), answers AS (
  SELECT *, list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant') AS a FROM chats
), sides AS (
  SELECT conv_id, c, CASE WHEN len(a) = 0 THEN c ELSE c[1:a[-1] - 1] || [{{'role': 'assistant',
    'text': CASE WHEN len(a) > 1 THEN c[a[-2]].text ELSE '' END}}] END AS r FROM answers
), prefixed AS (
  SELECT *, coalesce(list_position(list_transform(range(1, least(len(c), len(r)) + 1), lambda i: c[i] = r[i]), false) - 1,
                     least(len(c), len(r)))::INT AS n FROM sides
), cut AS (SELECT conv_id, n, c[1:n] AS p, c[n + 1:len(c)] AS x, r[n + 1:len(r)] AS y FROM prefixed)
SELECT conv_id, n AS n_prompt_turns, array_to_string({_RENDER.format("p")}, '') AS prompt,
  array_to_string({_RENDER.format("x")}, '') AS chosen, array_to_string({_RENDER.format("y")}, '') AS rejected,
  {_SPANS.format("x")} AS chosen_spans, {_SPANS.format("y")} AS rejected_spans
FROM cut
"""
