"""Chat formatting of conversations that were logged again after every turn.

A turn's prefix hash is the exclusive or of the hashes of the turns so far, each with its place, so
that it rolls along a window. Of conversations with equal last hashes the smallest id stays, and an
anti-join leaves out those whose last hash is a prefix hash of a longer one; the others are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as c

START, END = "<|im_start|>", "<|im_end|>"


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of each conversation of turns (conv_id, turn, role, text) that no other one begins with.

    Of equal conversations the smallest conv_id stays. Turns are in the order of turn, then role and
    text; nulls come first and are values like others, equal to each other alone. Repeated turns count
    each. Turns without a conv_id belong to no conversation.
    """
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    turns = turns.filter("conv_id is not null").select("conv_id", "turn", "role", "text")
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn("size", F.count("*").over(own))
    what = ["place", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.select("conv_id", "place", "size", F.bit_xor(F.xxhash64(*what)).over(so_far).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *what[::-1])).over(so_far).alias("b"))
    whole = F.col("place") == F.col("size")
    # Both sides of the anti-join have each key once, counted together before they are shuffled: no key is hot.
    ends = turns.filter(whole).groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    longer = turns.filter(~whole).select("place", "a", "b").distinct()
    return ends.join(longer, ["place", "a", "b"], "left_anti").select("conv_id")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chat) of the conversations that maximal() keeps.

    chat has each turn between START with its role, and END; null roles and texts are empty. What a
    text has of START and END stays as it is. Other columns aren't read; no rows give no rows.
    """
    kept = turns.select("conv_id", "turn", "role", "text").join(maximal(turns), "conv_id", "left_semi")
    each = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    whole = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("x"), "turn", F.col("role").isNotNull().alias("y"), "role", F.col("text").isNotNull().alias("z"), "text", each.alias("chat")))).alias("turns"))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.chat"), "").alias("chat"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(c.table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations),
p AS (SELECT *, string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM t),
k AS (SELECT min(CASE WHEN place = size THEN conv_id END) AS conv_id, bool_or(place < size) AS longer FROM p GROUP BY prefix),
m AS (SELECT conv_id FROM k WHERE conv_id IS NOT NULL AND NOT longer)
SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS chat
FROM t JOIN m USING (conv_id) GROUP BY conv_id
"""
