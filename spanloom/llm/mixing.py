"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only.

A document's size is its number of words. Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
the corpus size by weight; a target stops at MOST times its source's size, and the excess goes to the others by weight.
Each source's documents are dealt by a seeded hash to shards; a shard is a stream of words cut into blocks of BLOCK
words. Highest quotients v / (2 k - 1) give each source, then each of its shards, a whole number of blocks. A shard
takes whole passes over its stream and, for the rest, a run of blocks from a seeded start (its order is seeded too).

Null text has size 0 and takes nothing; a very long text is one document of its shard, and is cut between words like
others; null doc_id is a document like any other; rows that repeat each count; equal quotients go to the first source,
then the first shard; an empty table gives an empty mix; all-empty sources get target 0. Other columns are kept by
``mixed``, but the operator's own names win.

Sources are ordered in one task, one row for each: they are names of collections, some thousands at most, not a page's
address. A table with a source for each document needs a coarser column first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, packed_row, unpacked_row

MOST = 3
BLOCK = 16
#: Documents in a shard that a sort is planned for; a source has at most MAX_SHARDS shards.
SHARD_DOCS, MAX_SHARDS = 500, 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame) -> DataFrame:
    """n1 (is null), n2 (or ''), source, source_size and more -> also weight, target. One row per source comes in, so one task orders them.

    With sources by 3 * size / weight, those that stop are the first ones: a source stops if its bound per weight is
    below the level that the sources not stopped before it would share.
    """
    named = Window.orderBy("n1", F.encode("n2", "UTF-8"))
    whole = Window.partitionBy()
    bound = F.col("source_size") * MOST
    w = sources.withColumn("weight", (F.row_number().over(named) - 1) % 3 + 1)
    order = Window.orderBy(bound / F.col("weight"), "n1", "n2").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("bound_before")) / (F.col("weights") - F.col("weight_before"))
    w = (
        w.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("bound_before", F.coalesce(F.sum(bound).over(order), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("level", level)
        .withColumn("stops", bound / F.col("weight") < F.col("level"))
        # The level at the first source that does not stop is everyone's from there on.
        .withColumn("shared", F.min(F.when(~F.col("stops"), F.struct("weight_before", "level"))).over(whole)["level"])
    )
    return w.select(*sources.columns, "weight", F.when(F.col("stops"), bound.cast("double")).otherwise(F.col("weight") * F.col("shared")).alias("target"))


def highest_quotients(parties: DataFrame, group: list[str], tie: list[str], votes: str, seats: str, name: str) -> DataFrame:
    """Sainte-Laguë: the ``seats`` of each group go to its parties by the highest votes / (2 k - 1); ties by ``tie``.

    A party has all the seats well below its quota; only the quotients around the quota are ranked, in wider and wider
    windows until no party has used its window up or got nothing in it.
    """
    part = Window.partitionBy(*group)
    total = F.sum(votes).over(part)
    p = parties.withColumn("__quota", F.when(total > 0, F.col(votes) * F.col(seats) / total).otherwise(F.lit(0.0)))
    span = 3
    while True:
        q = p.withColumn("__base", F.greatest(F.floor("__quota") - span, F.lit(0)))
        q = q.withColumn("__left", F.col(seats) - F.sum("__base").over(part))
        by = part.orderBy((F.col(votes) / (2 * F.col("__k") - 1)).desc(), *tie, "__k")
        ranked = q.withColumn("__k", F.explode(F.sequence(F.col("__base") + 1, F.col("__base") + 2 * span + 1))).withColumn("__n", F.row_number().over(by))
        got = F.sum(((F.col("__n") <= F.col("__left")) & (F.col(votes) > 0)).cast("long"))
        won = ranked.groupBy(*parties.columns, "__base").agg(got.alias("__won"))
        if won.where(((F.col("__won") == 0) & (F.col("__base") > 0)) | (F.col("__won") == 2 * span + 1)).isEmpty():
            return won.select(*parties.columns, (F.col("__base") + F.col("__won")).alias(name))
        span *= 4


def _named(df: DataFrame) -> DataFrame:
    """Sources as two columns without nulls, so that they can be keys of plain joins and windows."""
    return df.withColumn("n1", F.col("source").isNull()).withColumn("n2", F.coalesce("source", F.lit("")))


def mix(docs: DataFrame, block: int = BLOCK, seed: str = SEED, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of each document, repeats counted."""
    out = mixed(docs.select("doc_id", "source", "text"), block, seed, shard_docs)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, block: int = BLOCK, seed: str = SEED, shard_docs: int = SHARD_DOCS, keep_text: bool = False) -> DataFrame:
    """``docs`` (text only if it is kept) with size, source_size, target, taken and pieces: the word ranges [lo, hi) taken, copy by copy."""
    scratch = Scratch(docs.sparkSession, "mix")
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    made = {"n1", "n2", "size", "h", "source_size", "target", "n_shards", "source_blocks", "shard", "shard_size", "shard_blocks", "taken", "pieces"}
    own = [F.col(f"`{c}`") for c in docs.columns if (c != "text" or keep_text) and c not in made]
    sized = docs.select(*own, word_count(F.col("text")).alias("size"), F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("h"))
    sized = scratch.put(_named(sized), "sized")
    per = sized.groupBy("n1", "n2", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    shards = F.least(F.ceil(F.col("n_docs") / shard_docs), F.lit(MAX_SHARDS))
    goals = targets(per.withColumn("n_shards", shards)).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    goals = scratch.put(goals.withColumn("all", F.lit(0)), "goals")
    quotas = highest_quotients(goals, ["all"], ["n1", "n2"], "target", "blocks", "source_blocks")
    quotas = scratch.put(quotas.select("n1", "n2", "source_size", "target", "n_shards", "source_blocks"), "quotas")
    # A hot source is spread over its shards; each shard is a bounded sort.
    dealt = sized.join(quotas, ["n1", "n2"]).withColumn("shard", F.pmod("h", "n_shards"))
    parts = dealt.groupBy("n1", "n2", "shard", "source_blocks").agg(F.sum("size").alias("shard_size"))
    parts = highest_quotients(parts, ["n1", "n2"], ["shard"], "shard_size", "source_blocks", "shard_blocks")
    parts = scratch.put(parts.select("n1", "n2", "shard", "shard_size", "shard_blocks"), "parts")
    stream = Window.partitionBy("n1", "n2", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("__end", F.sum("size").over(stream)).join(parts, ["n1", "n2", "shard"])
    pieces = _pieces(block, seed)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"])
    return placed.withColumn("pieces", pieces).select(*own, "size", "source_size", "target", taken.alias("taken"), "pieces")


def _pieces(block: int, seed: str) -> Column:
    """Word ranges of a document that its shard's blocks cover: whole passes, then the run's overlap (in two where it wraps)."""
    size, end, whole = F.col("size"), F.col("__end"), F.col("shard_size")
    n = F.greatest(F.ceil(whole / block), F.lit(1))
    quota = F.least(F.col("shard_blocks"), MOST * n)
    passes, rest = F.floor(quota / n), quota % n
    first = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "n1", "n2", "shard")), 1, 15), 16, 10).cast("long") % n
    part = lambda lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    overlap = lambda lo, hi: part(F.greatest(lo - (end - size), F.lit(0)), F.least(hi - (end - size), size))
    run = F.array(overlap(first * block, F.least((first + rest) * block, whole)), overlap(F.lit(0), (first + rest - n) * block))
    every = F.array_repeat(part(F.lit(0), size), passes.cast("int"))
    return F.filter(F.concat(every, run), lambda p: p["hi"] > p["lo"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each copy; a part of a document is cut between words."""
    m = mixed(docs.select(packed_row(docs, "text"), "doc_id", "source", "text"), keep_text=True, **options).withColumn("__piece", F.explode("pieces"))
    lo, hi = F.col("__piece.lo"), F.col("__piece.hi")
    # Words with the white space after them; a part begins with a word.
    words = F.split(F.regexp_replace("text", f"^[{SPACE_CLASS}]+", ""), f"(?<=[{SPACE_CLASS}])(?=[^{SPACE_CLASS}])")
    cut = F.concat_ws("", F.slice(words, (lo + 1).cast("int"), (hi - lo).cast("int")))
    text = F.when((lo == 0) & (hi == F.col("size")), F.col("text")).otherwise(cut)
    m = m.select("__row", text.alias("text"))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return unpacked_row(m, docs.columns, made)
