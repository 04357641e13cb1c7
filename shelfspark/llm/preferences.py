"""Preference formatting: the common turns of a chosen and a rejected conversation once, then what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written: before the role, after it, after the text.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Only turns of this role count for training.
TRAINED = "assistant"


def conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col`` and turns: the conversation's (role, text) in order of turn, then role, then text.

    Null roles and texts are empty, a null turn comes first, rows without an id are no conversation. A
    conversation is one value in the result, so its rows meet in one task; different ones do not.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return grouped.select(F.col("_id").alias(id_col), F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def last_turn(turns: Column, role: str = TRAINED) -> Column:
    """Place (from 1) of the last turn of a role, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == role, i + 1))), F.lit(0))


def swapped(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col``, chosen and rejected: each conversation, and up to its last answer the same with the last
    answer of its partner (the id that differs in the lowest bit) in place of what follows.

    Without an answer both are the whole conversation; where the partner has none, rejected ends before
    the answer.
    """
    own = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col("turns").alias("chosen"), last_turn(F.col("turns")).alias("_last"))
    answers = own.filter("_last > 0").select(F.col("_id").bitwiseXOR(F.lit(1).cast("bigint")).alias("_id"), F.element_at("chosen", F.col("_last")).alias("_answer"))
    joined = own.join(answers, "_id", "left")
    before = F.slice("chosen", F.lit(1), F.greatest(F.col("_last") - 1, F.lit(0)))
    other = F.when(F.col("_answer").isNull(), before).otherwise(F.concat(before, F.array("_answer")))
    return joined.select(F.col("_id").alias(id_col), "chosen", F.when(F.col("_last") == 0, F.col("chosen")).otherwise(other).alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two lists of turns."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, n).otherwise((first - 1).cast("int"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """Loss mask of rendered turns, in runs of characters: "<length>x<0 or 1>", each turn's head, then the rest.

    The text and the closing mark of an answer are 1; heads and the turns of others are 0.
    """
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(AFTER_ROLE)
    body = lambda t: F.length(t["text"]) + len(CLOSE)
    runs = F.transform(turns, lambda t: F.concat(head(t).cast("string"), F.lit("x0 "), body(t).cast("string"), F.when(t["role"] == TRAINED, F.lit("x1")).otherwise(F.lit("x0"))))
    return F.array_join(runs, " ")


def format_preferences(df: DataFrame, id_col: str = "conv_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """``id_col``, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    The columns hold lists of (role, text). Their longest common prefix is rendered once as prompt; the
    rest of each side is its completion, with a mask. Equal sides leave both completions empty, a null side
    has no turns. Rows stay as they are many; other columns are ignored.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(chosen_col), none).alias("_c"), F.coalesce(F.col(rejected_col), none).alias("_r"))
    cut = sides.withColumn("_n", common_turns(F.col("_c"), F.col("_r")))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.size(c))
    cut = cut.withColumns({"_p": F.slice("_c", F.lit(1), F.col("_n")), "_c": rest("_c"), "_r": rest("_r")})
    return cut.select(F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_prompt_turns"), rendered(F.col("_p")).alias("prompt"), rendered(F.col("_c")).alias("chosen"), rendered(F.col("_r")).alias("rejected"), mask(F.col("_c")).alias("chosen_mask"), mask(F.col("_r")).alias("rejected_mask"))


def swapped_sql() -> str:
    """DuckDB SQL for ``format_preferences(swapped(conversations))`` over the table conversations."""
    turn = f"'{OPEN}' || role || chr(10) || text || '{CLOSE.strip()}' || chr(10)"
    runs = f"(length(role) + {len(OPEN) + len(AFTER_ROLE)}) || 'x0 ' || (length(text) + {len(CLOSE)}) || CASE WHEN role = '{TRAINED}' THEN 'x1' ELSE 'x0' END"
    side = lambda name: f"SELECT s.conv_id, string_agg({turn}, '' ORDER BY i) AS {name}, string_agg({runs}, ' ' ORDER BY i) AS {name}_mask"
    return f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) WHERE conv_id IS NOT NULL),
la AS (SELECT conv_id, max(i) AS li FROM t WHERE role = '{TRAINED}' GROUP BY conv_id),
r AS (SELECT t.conv_id, t.role, t.text, t.i FROM t LEFT JOIN la ON t.conv_id = la.conv_id WHERE la.li IS NULL OR t.i < la.li
      UNION ALL SELECT la.conv_id, p.role, p.text, la.li FROM la JOIN la AS pa ON pa.conv_id = xor(la.conv_id, 1) JOIN t AS p ON p.conv_id = pa.conv_id AND p.i = pa.li),
same AS (SELECT t.conv_id, t.i FROM t JOIN r ON t.conv_id = r.conv_id AND t.i = r.i AND t.role = r.role AND t.text = r.text),
run AS (SELECT conv_id, i, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k FROM same),
n AS (SELECT c.conv_id, count(run.k) AS n FROM (SELECT DISTINCT conv_id FROM t) AS c LEFT JOIN run ON run.conv_id = c.conv_id AND run.i = run.k GROUP BY c.conv_id),
p AS ({side('prompt')} FROM t AS s JOIN n ON n.conv_id = s.conv_id WHERE i <= n GROUP BY s.conv_id),
c AS ({side('chosen')} FROM t AS s JOIN n ON n.conv_id = s.conv_id WHERE i > n GROUP BY s.conv_id),
d AS ({side('rejected')} FROM r AS s JOIN n ON n.conv_id = s.conv_id WHERE i > n GROUP BY s.conv_id)
SELECT n.conv_id, CAST(n AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM n LEFT JOIN p ON p.conv_id = n.conv_id LEFT JOIN c ON c.conv_id = n.conv_id LEFT JOIN d ON d.conv_id = n.conv_id
"""
