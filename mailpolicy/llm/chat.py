"""Chat formatting with cumulative snapshots collapsed, in DataFrame functions only.

Loggers often write a conversation again after every turn, so that each log is a prefix of the next. A rolling hash of every turn prefix
is taken: the exclusive or of hashes of (position, role, text) over the turns so far, 128 bits. A conversation whose last prefix is a
proper prefix of a longer one falls to an anti-join; of equal conversations the one of the smallest id stays. Only digests move for this;
texts of conversations that stay are shuffled once, to be rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailpolicy.llm.common import kept


def _digest(salt: int, *columns):
    return F.xxhash64(F.lit(salt), *columns)


def _said(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _digests(turns: DataFrame) -> list:
    parts = [F.length(_said("role")), _said("role"), _said("text")]  # with the length, no two pairs read alike
    return [_digest(s, *parts).alias(f"t{s}") for s in (1, 2)]


def _line(role, text):
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def collapsed(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal of the conversations that stay. n_equal: conversations with just these turns, itself included."""
    return _collapsed(turns).select("conv_id", "n_turns", "n_equal")


def _nameless(turns: DataFrame) -> DataFrame:
    """Rows of a null conv_id, each as the only turn of a conversation of its own: n, p1, p2 as of prefixes, and the row's line."""
    rows = turns.filter(F.col("conv_id").isNull())
    alone = rows.select("conv_id", F.lit(1).cast("long").alias("n"), *_digests(rows), _line(_said("role"), _said("text")).alias("line"))
    return alone.select("conv_id", "n", *(_digest(s, "n", "t1", "t2").alias(f"p{s}") for s in (1, 2)), "line")


def _collapsed(turns: DataFrame) -> DataFrame:
    """``collapsed`` with the digest of all turns, p1 and p2."""
    named = turns.filter(F.col("conv_id").isNotNull())
    digests = named.select("conv_id", "turn", _said("role").alias("role"), *_digests(named))
    mine = digests.repartition("conv_id").dropDuplicates(["conv_id", "turn", "role", "t1", "t2"])
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "t1", "t2")
    numbered = mine.withColumn("n", F.row_number().over(by_turn).cast("long"))
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = numbered.select("conv_id", "n", *(F.bit_xor(_digest(s, "n", "t1", "t2")).over(so_far).alias(f"p{s}") for s in (1, 2)))
    prefixes = prefixes.withColumn("last", F.lead("n").over(Window.partitionBy("conv_id").orderBy("n")).isNull())
    alone = _nameless(turns).select("conv_id", "n", "p1", "p2", F.lit(True).alias("last"))
    prefixes = kept(prefixes.unionByName(alone), "prefixes")
    key = ["n", "p1", "p2"]
    whole = prefixes.filter("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    inner = prefixes.filter("not last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_equal", "p1", "p2")


def rendered(turns: DataFrame, collapse: bool = True) -> DataFrame:
    """conv_id, n_turns, n_equal, text: conversations that are no prefix of another, as ChatML.

    Turns are taken in the order of (turn, role, text), null turn numbers first; a row that repeats another one of its conversation
    counts once. Null roles and texts are empty. Each row of a null conv_id is a conversation of its own, of one turn and of null id; among
    equal conversations an id goes before null. An empty table gives no rows; other columns are not looked at.
    """
    stay = kept(_collapsed(turns), "stay")
    named = stay.filter(F.col("conv_id").isNotNull())
    mine = turns.select("conv_id", "turn", _said("role").alias("role"), _said("text").alias("text"))
    wanted = mine.join(named.select(F.col("conv_id").alias("stays")), F.col("conv_id") == F.col("stays"), "left_semi")
    turn = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", _digest(1, F.length("role"), "role", "text").alias("t1"), _digest(2, F.length("role"), "role", "text").alias("t2"), "text")
    ordered = F.array_sort(F.collect_set(turn))
    texts = wanted.groupBy(F.col("conv_id").alias("conv")).agg(F.array_join(F.transform(ordered, lambda t: _line(t.role, t.text)), "").alias("text"))
    of_named = named.join(texts, F.col("conv_id") == F.col("conv")).select("conv_id", "n_turns", "n_equal", "text")
    lines = _nameless(turns).groupBy("p1", "p2").agg(F.min("line").alias("text"))
    alone = stay.filter(F.col("conv_id").isNull()).join(lines, ["p1", "p2"]).select("conv_id", "n_turns", "n_equal", "text")
    return of_named.union(alone)
