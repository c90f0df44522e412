"""Chat formatting after collapsing logged snapshots of growing conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from soundledger.llm.common import materialize

#: Each turn adds a number below this to two sums; 2 ** 23 turns fit a long.
_ROOM = 1 << 40
START, END = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, n, a, b)``: for each turn the rolling hashes of the conversation up to it, and its number of turns.

    A turn's hash covers its position, role and text, so sums of them identify a prefix; they run along one sorted window
    that spills, whatever the length of a conversation. A row equal to the one before counts once.
    """
    order = ["turn", "role", "text"]
    own = W.partitionBy("conv_id").orderBy(*order)
    rows = turns.withColumn("again", F.coalesce(F.lag(F.struct(*order)).over(own).eqNullSafe(F.struct(*order)) & (F.row_number().over(own) > 1), F.lit(False)))
    rows = rows.filter(~F.col("again")).withColumn("pos", F.row_number().over(own))

    def part(seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "pos", "role", F.col("role").isNull(), "text", F.col("text").isNull()), F.lit(_ROOM))

    so_far = own.rowsBetween(W.unboundedPreceding, 0)
    return rows.select(
        "conv_id", "pos", F.count("*").over(W.partitionBy("conv_id")).alias("n"), F.sum(part(1)).over(so_far).alias("a"), F.sum(part(2)).over(so_far).alias("b")
    )


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", start: str = START, end: str = END
) -> DataFrame:
    """``(conv_id, n_turns, copies, text)``: each conversation that no longer one begins with, rendered.

    A conversation is the sequence of roles and texts of its rows by turn, then role and text; rows repeated exactly count
    once. Conversations that are proper prefixes of another drop out by an anti-join on rolling hashes; of equal ones the
    smallest id stays, and ``copies`` counts them. Null ids form one conversation. Null roles and texts are empty when
    rendered but differ from empty ones. Other columns are ignored. An empty table gives no rows.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    marks = materialize(turn_prefixes(rows), "chat-prefixes")
    whole = marks.filter("pos = n").groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    shorter = marks.filter("pos < n").select("pos", "a", "b").distinct()
    kept = materialize(whole.join(shorter, ["pos", "a", "b"], "left_anti").select(F.col("conv_id").alias("kept"), "copies"), "chat-kept")
    met = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")))
    ordered = F.array_sort(F.collect_set(F.struct("turn", "role", "text")))
    said = F.transform("turns", lambda t: F.concat(F.lit(start), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(end + "\n")))
    chats = met.groupBy("conv_id").agg(F.max("copies").alias("copies"), ordered.alias("turns"))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", F.array_join(said, "").alias("text"))


CHAT_SQL = r"""
    WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    c AS (
        SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id
    ), shorter AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(generate_series(1, len(l) - 1)) AS i FROM c))
    SELECT min(conv_id) AS conv_id, CAST(len(l) AS BIGINT) AS n_turns, count(*) AS copies,
           array_to_string(list_transform(l, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), '') AS text
    FROM c WHERE NOT EXISTS (SELECT 1 FROM shorter s WHERE s.l = c.l) GROUP BY l
"""
