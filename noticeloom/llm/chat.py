"""Operator 7: multi-party dialogues, rendered once from each participant's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import table
from noticeloom.operators.ordering import running_total

#: Fixed marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Characters of one rendered row, about; only dialogues that no row could hold are longer.
PART_CHARS = 8 << 20
#: How a speaker that is not the learner is shown, and the learner.
OTHER, LEARNER = "user name=", "assistant"


def plain(text: Column) -> Column:
    """Marks broken up by a blank, so that a text cannot open or close a turn."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def named(role: Column, system_role: str) -> Column:
    """How a turn is headed for those who do not speak it."""
    return F.when(role == system_role, role).otherwise(F.concat(F.lit(OTHER), role))


def dealt_into_parts(rows: DataFrame, part_chars: int) -> DataFrame:
    """``rows`` with ``part``: 0, but for dialogues of more than ``part_chars``, cut between turns about that far apart."""
    sizes = rows.groupBy("conv_id").agg(F.sum("size").alias("all"))
    large = sizes.where(F.col("all") > part_chars).select("conv_id")
    if large.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    # no more of them than the table has such amounts of text
    cut_up = running_total(rows.join(large, "conv_id", "left_semi"), ["turn", "role", "text"], "upto", F.col("size"), ["conv_id"])
    cut_up = cut_up.withColumn("part", F.floor((F.col("upto") - F.col("size")) / part_chars)).drop("upto")
    return cut_up.unionByName(rows.join(large, "conv_id", "left_anti").withColumn("part", F.lit(0).cast("long")))


def perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_role: str = "system",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """One row per dialogue and participant: ``text``, its number of turns and the training mask.

    For every speaker but ``system_role`` the dialogue is rendered with that speaker as
    ``assistant``, the others as ``user name=...`` and system turns unchanged. ``mask`` holds a
    character per turn (1: this speaker's, to be learned), ``spans`` the code-point range
    of each learned text, its closing mark included. Marks inside texts and roles are broken up by a
    blank, line ends inside roles are blanks, so that neither opens or closes a turn.

    Turns go by number, ties by role and text, so repeated rows follow each other; a null turn number comes
    first, a null text is empty, a null role is the speaker ``unknown``. A turn without a dialogue id is a
    dialogue of its own. A dialogue is one row, ``part`` 0, up to ``part_chars`` characters with its marks;
    only a longer one, which may hold any share of the table, goes on in further parts, each of which
    begins with the dialogue's first system turn. A turn is never cut. Dialogues of system turns alone have no
    speaker and no row; an empty table gives none; other columns play no part.
    """
    role = F.regexp_replace(F.coalesce(F.col(role_col), F.lit("unknown")), r"[\r\n]+", " ")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
        plain(role).alias("role"),
        plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    marks = len(OPEN) + len(CLOSE) + 2
    rows = rows.withColumn("size", (F.char_length(named(F.col("role"), system_role)) + F.char_length("text") + marks).cast("long"))
    known = dealt_into_parts(rows.where("conv_id is not null"), part_chars)
    key = ["conv_id", "part"]
    upto = Window.partitionBy(*key).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.struct("turn", "role", "text", F.col("stop"))
    gathered = known.withColumn("stop", F.sum("size").over(upto)).groupBy(*key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    system = F.col("role") == system_role
    first = known.where(system).groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", F.col("size").alias("stop"))).alias("lead"))
    shared = gathered.where("part = 0").withColumn("lead", F.lit(None).cast(first.schema["lead"].dataType))
    later = gathered.where("part > 0").join(first, "conv_id", "left")
    # a first system turn that comes later leads only what follows it
    before = F.struct(F.col("lead.turn"), F.col("lead.role"), F.col("lead.text")) < F.struct(F.get("turns", F.lit(0))["turn"], F.get("turns", F.lit(0))["role"], F.get("turns", F.lit(0))["text"])
    later = later.withColumn("lead", F.when(before, F.col("lead")))
    speakers = known.where(~system).select("conv_id", F.col("role").alias("speaker")).distinct()
    alone = rows.where(F.col("conv_id").isNull() & ~system).select("conv_id", F.lit(0).cast("long").alias("part"), F.array(F.struct("turn", "role", "text", F.col("size").alias("stop"))).alias("turns"), F.lit(None).cast(first.schema["lead"].dataType).alias("lead"), F.col("role").alias("speaker"))
    sides = shared.unionByName(later).join(speakers, "conv_id").unionByName(alone)

    head = lambda t: F.when(t["role"] == F.col("speaker"), LEARNER).otherwise(named(t["role"], system_role))
    shown = lambda t: F.concat(F.lit(OPEN), head(t), F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))
    led = F.col("lead").isNotNull()
    # where a turn of the speaker ends: after all turns as others see them, and what each own one is shorter by
    shift = F.coalesce(F.col("lead.stop"), F.lit(0))
    less = F.char_length(F.col("speaker")) + len(OTHER) - len(LEARNER)
    own = F.filter("turns", lambda t: t["role"] == F.col("speaker"))
    end = lambda t, i: shift + t["stop"] - (i + 1) * less - 1
    span = lambda t, i: F.concat_ws(":", end(t, i) - len(CLOSE) - F.char_length(t["text"]), end(t, i))
    body = F.array_join(F.transform("turns", shown), "")
    mask = F.array_join(F.transform("turns", lambda t: F.when(t["role"] == F.col("speaker"), "1").otherwise("0")), "")
    return sides.select(
        "conv_id",
        "part",
        "speaker",
        (F.size("turns") + F.when(led, 1).otherwise(0)).alias("n_turns"),
        F.when(led, F.concat(shown(F.col("lead")), body)).otherwise(body).alias("text"),
        F.when(led, F.concat(F.lit("0"), mask)).otherwise(mask).alias("mask"),
        F.array_join(F.transform(own, span), " ").alias("spans"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


_SIDE = f"CASE WHEN role = speaker THEN '{LEARNER}' WHEN role = 'system' THEN role ELSE '{OTHER}' || role END"
OP7_SQL = f"""
WITH n AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, coalesce(turn, -1) AS turn,
         regexp_replace(coalesce(role, 'unknown'), '[\\r\\n]+', ' ', 'g') AS role, coalesce(text, '') AS text FROM conversations),
r AS (
  SELECT conv_id, lone, turn, replace(replace(role, '{OPEN}', '<| im_start|>'), '{CLOSE}', '<| im_end|>') AS role,
         replace(replace(text, '{OPEN}', '<| im_start|>'), '{CLOSE}', '<| im_end|>') AS text FROM n),
z AS (SELECT *, length(CASE WHEN role = 'system' THEN role ELSE '{OTHER}' || role END) + length(text) + {len(OPEN) + len(CLOSE) + 2} AS size FROM r),
q AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, lone ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - size AS upto, sum(size) OVER (PARTITION BY conv_id, lone) AS total FROM z),
p AS (SELECT *, CASE WHEN total > {PART_CHARS} AND conv_id IS NOT NULL THEN CAST(upto // {PART_CHARS} AS BIGINT) ELSE 0 END AS part FROM q),
f AS (SELECT conv_id, min((turn, role, text)) AS lead, arg_min(size, (turn, role, text)) AS size FROM p WHERE role = 'system' AND conv_id IS NOT NULL GROUP BY conv_id),
g AS (SELECT conv_id, part, min((turn, role, text)) AS begin FROM p WHERE part > 0 GROUP BY conv_id, part),
a AS (
  SELECT conv_id, lone, part, turn, role, text, 1 AS led FROM p
  UNION ALL SELECT g.conv_id, NULL, g.part, NULL, 'system', f.lead[3], 0 FROM g JOIN f ON g.conv_id = f.conv_id WHERE f.lead < g.begin),
s AS (SELECT DISTINCT conv_id, lone, role AS speaker FROM r WHERE role <> 'system'),
x AS (
  SELECT a.*, speaker, '{OPEN}' || {_SIDE} || chr(10) || text || '{CLOSE}' || chr(10) AS seg
  FROM a JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.lone IS NOT DISTINCT FROM s.lone),
y AS (SELECT *, sum(length(seg)) OVER (PARTITION BY conv_id, lone, part, speaker ORDER BY led, turn, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM x)
SELECT conv_id, part, speaker, CAST(count(*) AS INTEGER) AS n_turns, string_agg(seg, '' ORDER BY led, turn, role, text) AS text,
       string_agg(CASE WHEN role = speaker THEN '1' ELSE '0' END, '' ORDER BY led, turn, role, text) AS mask,
       coalesce(string_agg(CAST(CAST(stop - 1 - {len(CLOSE)} - length(text) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop - 1 AS BIGINT) AS VARCHAR), ' ' ORDER BY led, turn, role, text) FILTER (WHERE role = speaker), '') AS spans
FROM y GROUP BY conv_id, lone, part, speaker
"""
