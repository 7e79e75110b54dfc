"""Preference formatting: pairs of conversations with a shared beginning become one prompt and two masked completions.

The longest run of turns (role and text, in turn order) that the chosen and the rejected conversation share, up to and
with the last turn that an assistant answers in both, is rendered once as the prompt. Each rest is rendered as a
completion. Masks are spans of characters: a completion is trained on where an assistant speaks, with the mark that
ends its turn; the prompt never.

Where a table has no pairs of its own, ``paired`` builds them: conversations with the same first user turn (system turns
before it included) are a group; the one with most assistant words (then the least id) is chosen, each other one is
rejected against it. A conversation alone in its group is paired with itself cut before its last assistant turn's text.

Null roles count as 'user' and null texts as empty; turns with equal numbers are ordered by role and text, and turns
that are equal in all of them are one. Rows without a conv_id or a turn number are no turns. Very long texts are rendered
whole; a conversation's turns are one row, and so bounded by a row's size. Of chosen candidates with as many words the
least id is taken. Empty conversations have no pairs, an empty table gives an empty result, and other columns are not
looked at, whatever their names. An opening that very many conversations share is one text joined to all of them, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written. Fixed values of the common chat markup.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text), in order."""
    one = turns.where("conv_id is not null and turn is not null").select(
        "conv_id",
        F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def _said(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _words(turns: Column) -> Column:
    said = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.aggregate(said, F.lit(0), lambda n, t: n + F.regexp_count(t["text"], F.lit(r"[^\x20\x09-\x0D]+")))


def paired(turns: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, chosen, rejected (arrays of role and text)."""
    c = conversations(turns).withColumn("words", _words(F.col("turns"))).withColumn("turns", _said(F.col("turns")))
    first = F.array_position(F.transform("turns", lambda t: t["role"]), F.lit("user")).cast("int")
    c = c.withColumn("opening", F.slice("turns", 1, F.greatest(first, F.lit(1)))).withColumn("key", F.sha2(F.to_json("opening"), 256))
    # The best of a group is found by a partial aggregate of ids and counts, and joined back; groups are never gathered.
    best = c.groupBy("key").agg(F.min(F.struct((-F.col("words")).alias("w"), F.col("conv_id").alias("best"))).alias("b"), F.count("*").alias("group_size")).select("key", "b.best", "group_size")
    chosen = c.join(best, "key").where("conv_id = best").select("key", F.col("best").alias("chosen_id"), F.col("turns").alias("chosen"), "group_size")
    several = c.select("key", "conv_id", "turns").join(chosen.where("group_size > 1"), "key").where("conv_id != chosen_id")
    several = several.select(F.col("conv_id").alias("pair_id"), "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))
    last = F.size("chosen") - F.array_position(F.reverse(F.transform("chosen", lambda t: t["role"])), F.lit("assistant")).cast("int") + 1
    alone = chosen.where("group_size = 1").where(F.exists("chosen", lambda t: t["role"] == "assistant")).withColumn("last", last)
    empty = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("").alias("text")))
    alone = alone.select(F.col("chosen_id").alias("pair_id"), "chosen_id", F.lit(None).cast("bigint").alias("rejected_id"), "chosen", F.concat(F.slice("chosen", F.lit(1), F.col("last") - 1), empty).alias("rejected"))
    return several.unionByName(alone)


def _rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))))


def _mask(turns: Column) -> Column:
    """[lo, hi) character spans of what assistants say, with CLOSE, in the rendered turns."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<lo: bigint, hi: bigint>>").alias("spans"))

    def step(s, t):
        lo = s["at"] + F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        hi = lo + F.length(t["text"]) + len(CLOSE)
        spans = F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))))).otherwise(s["spans"])
        return F.struct(hi.cast("bigint").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """``pairs`` (chosen, rejected: arrays of role and text) -> ids, n_shared, prompt, and for each side completion and mask."""
    n = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.element_at("chosen", i).eqNullSafe(F.element_at("rejected", i)))
    p = pairs.withColumn("__n", n).withColumn("n_shared", F.when(F.col("__n") == 0, 0).otherwise(F.coalesce(F.element_at(F.when(F.size(differ) > 0, differ), 1) - 1, F.col("__n"))))
    # Equal up to the end of the shorter: its last turn is what both answer with, so it belongs to the completions.
    p = p.withColumn("n_shared", F.when((F.col("n_shared") == F.col("__n")) & (F.col("__n") > 0), F.col("__n") - 1).otherwise(F.col("n_shared")))
    rest = lambda side: F.slice(side, F.col("n_shared") + 1, F.greatest(F.size(side) - F.col("n_shared"), F.lit(0)))
    p = p.withColumn("__p", F.slice("chosen", F.lit(1), F.col("n_shared"))).withColumn("__c", rest("chosen")).withColumn("__r", rest("rejected"))
    return p.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_shared").cast("bigint").alias("n_shared"), _rendered(F.col("__p")).alias("prompt"),
        _rendered(F.col("__c")).alias("chosen_completion"), _mask(F.col("__c")).alias("chosen_mask"),
        _rendered(F.col("__r")).alias("rejected_completion"), _mask(F.col("__r")).alias("rejected_mask"),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    return formatted(paired(turns))
