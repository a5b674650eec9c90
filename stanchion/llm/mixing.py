"""Mixing sources to target weights, with DataFrame functions only.

Source i holds a share p_i of all tokens (words). Its weight is p_i**a over the sum of these, so a = 1
keeps the shares and a = 0 makes them equal. The exponent a is bisected twice: to the entropy that
lies `gain` of the way from the shares' to the most possible, and to the least exponent at which no
source is repeated more than `max_repeats` times; the larger of the two holds. The budget is the
least number of tokens at which every source runs through at least once whole, unless given.

A source's weight times the budget is its tokens: whole epochs of all its documents, and a rest that
the next epoch's permutation gives up to the last document that still fits. The permutation orders
blocks by a hash, and the documents of a block by a hash. A source of n documents has about sqrt(n)
blocks of sqrt(n) documents, so both windows below stay small for a source of any size, and sums run
in two steps: over blocks, then inside them. What is kept per source is one row: epochs and the
place in the permutation at which it ends. Documents meet these rows without being shuffled.

Defined results: a null source is a source of its own; null or blank text counts no tokens, and a
source without tokens has weight 0 and goes in once; documents with equal ids go in or stay out of
the last epoch together; a budget below one epoch drops documents by the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._base import keep

GAIN, MAX_REPEATS, STEPS, SEED = 0.5, 4.0, 40, "mix"


def tokens(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_hash(id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}-doc-"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def block_of(id_col: str, blocks: str) -> Column:
    seen = F.md5(F.concat(F.lit(f"{SEED}-block-"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(seen, 1, 8), 16, 10).cast("long") % F.col(blocks)


def block_hash(block: str) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}-order-"), F.col(block).cast("string")).cast("binary"))


def _powers(shares: Column, a: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a))


def _entropy(shares: Column, a: Column) -> Column:
    """Of the weights at exponent a: ln Z - (a / Z) * sum of p**a ln p."""
    z = _powers(shares, a)
    return F.ln(z) - a / z * F.aggregate(shares, F.lit(0.0), lambda s, p: s + F.pow(p, a) * F.ln(p))


def _bisect(keeps: Column, up_if) -> Column:
    """The exponent in [0, 1] at which up_if(mid) turns; the upper bound after STEPS halvings."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(b, _):
        mid = (b.lo + b.hi) / 2
        up = up_if(mid)
        return F.struct(F.when(up, mid).otherwise(b.lo).alias("lo"), F.when(up, b.hi).otherwise(mid).alias("hi"))

    return F.aggregate(keeps, start, step).hi


def weights(docs: DataFrame, source_col: str = "source", text_col: str = "text", gain: float = GAIN, max_repeats: float = MAX_REPEATS, budget: float | None = None, counted: DataFrame | None = None) -> DataFrame:
    """One row per source: src, docs, tokens, share, weight, exponent, epochs, rest (tokens of the last, partial epoch)."""
    if counted is None:
        counted = docs.select(F.col(source_col).alias("src"), tokens(text_col).alias("n"))
    own = counted.groupBy("src").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    # one number for each source that has tokens
    shares = own.agg(F.sum("tokens").cast("double").alias("total"), F.sort_array(F.collect_list(F.when(F.col("tokens") > 0, F.col("tokens").cast("double")))).alias("held"))
    shares = shares.select("total", F.transform("held", lambda x: x / F.col("total")).alias("p"))
    p, steps = F.col("p"), F.sequence(F.lit(1), F.lit(STEPS))
    goal = _entropy(p, F.lit(1.0)) + gain * (F.ln(F.size(p).cast("double")) - _entropy(p, F.lit(1.0)))
    shares = shares.filter(F.size(p) > 0).withColumn("goal", goal)
    by_entropy = _bisect(steps, lambda a: _entropy(p, a) >= F.col("goal"))
    spread = F.element_at(p, -1) / F.element_at(p, 1)
    by_repeats = _bisect(steps, lambda a: F.pow(spread, 1.0 - a) > max_repeats)
    shares = shares.withColumn("exponent", F.greatest(by_entropy, by_repeats))
    shares = shares.withColumn("z", _powers(p, F.col("exponent")))
    whole = F.col("total") * F.col("z") * F.pow(F.element_at(p, -1), 1.0 - F.col("exponent"))
    shares = shares.withColumn("budget", whole if budget is None else F.lit(float(budget)))
    # one row; joined to one row per source
    met = own.join(F.broadcast(shares.select("total", "exponent", "z", "budget")), F.lit(True), "left")
    met = met.withColumn("share", F.when(F.col("tokens") > 0, F.col("tokens") / F.col("total")).otherwise(0.0))
    met = met.withColumn("weight", F.when(F.col("tokens") > 0, F.pow("share", "exponent") / F.col("z")).otherwise(0.0))
    met = met.withColumn("goal", F.when(F.col("tokens") > 0, F.floor(F.col("weight") * F.col("budget") + 1e-6)).otherwise(0).cast("long"))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(1).cast("long")
    met = met.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("tokens") > 0, F.col("goal") - F.col("epochs") * F.col("tokens")).otherwise(0))
    return met.select("src", "docs", "tokens", "share", "weight", "exponent", "epochs", "rest")


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """weights() and per source the end of its partial epoch: last_block, last_doc (hashes; null: it is empty), blocks."""
    counted = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), tokens(text_col).alias("n")), "counted")
    told = keep(weights(docs, counted=counted, **how).withColumn("blocks", F.ceil(F.sqrt("docs")).cast("long")), "weights")
    some = told.filter("rest > 0").select("src", "rest", "blocks")
    rows = counted.join(some, counted.src.eqNullSafe(some.src)).select(some.src, "rest", "n", doc_hash("id").alias("doc_hash"), block_of("id", "blocks").alias("block"))
    blocks = rows.groupBy("src", "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).withColumn("block_hash", block_hash("block"))
    run = W.partitionBy("src").orderBy("block_hash")
    # the blocks that fit whole, and of the first that does not, what room is left
    placed = blocks.withColumn("upto", F.sum("n").over(run))
    full = placed.groupBy("src").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("block_hash"))).alias("whole"), F.min_by(F.struct("block", "block_hash", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")), F.when(F.col("upto") > F.col("rest"), F.col("block_hash"))).alias("cut"))
    full = keep(full, "cuts")
    inside = rows.join(full.select(F.col("src").alias("own"), "cut").filter("cut is not null"), rows.src.eqNullSafe(F.col("own")) & (rows.block == F.col("cut.block")))
    inner = W.partitionBy("src").orderBy("doc_hash")  # rows of one block of each source
    last = inside.select("src", "doc_hash", F.col("cut.room").alias("room"), F.sum("n").over(inner).alias("upto")).filter("upto <= room").groupBy("src").agg(F.max("doc_hash").alias("last_doc"))
    ends = full.alias("f").join(last.alias("l"), F.col("f.src").eqNullSafe(F.col("l.src")), "left").select(F.col("f.src").alias("own"), "whole", F.col("cut.block_hash").alias("cut_block"), "last_doc")
    return keep(told.join(ends, told.src.eqNullSafe(ends.own), "left").drop("own"), "plan")


def copies(planned_blocks: str = "blocks", id_col: str = "doc_id") -> Column:
    """How often a document goes in, beside its source's row of plan()."""
    b = F.md5(F.concat(F.lit(f"{SEED}-order-"), block_of(id_col, planned_blocks).cast("string")).cast("binary"))
    more = (b <= F.col("whole")) | ((b == F.col("cut_block")) & (doc_hash(id_col) <= F.col("last_doc")))
    return F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")


def allot(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """doc_id, source, weight, copies: one row per row of docs."""
    told = plan(docs, id_col, source_col, text_col, **how)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    met = rows.join(told, rows.source.eqNullSafe(told.src))
    return met.select("doc_id", "source", "weight", copies().alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", order: bool = False, **how) -> DataFrame:
    """The rows of docs, each as often as it goes in; with order, also epoch and order_key, the place in its source's permutation."""
    told = plan(docs, id_col, source_col, text_col, **how)
    told = told.select(*(F.col(c).alias(f"_mix_{c}") for c in told.columns))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_mix_row")
    keyed = docs.select(row, F.col(f"`{id_col}`").alias("_mix_id"), F.col(f"`{source_col}`").alias("_mix_source"))
    met = keyed.join(told, keyed._mix_source.eqNullSafe(told._mix_src))
    b = F.md5(F.concat(F.lit(f"{SEED}-order-"), block_of("_mix_id", "_mix_blocks").cast("string")).cast("binary"))
    more = (b <= F.col("_mix_whole")) | ((b == F.col("_mix_cut_block")) & (doc_hash("_mix_id") <= F.col("_mix_last_doc")))
    n = F.col("_mix_epochs") + F.coalesce(more, F.lit(False)).cast("long")
    out = met.withColumn("_mix_n", n).filter("_mix_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n"))))
    if order:
        return out.select("_mix_row.*", "epoch", F.concat(b, doc_hash("_mix_id")).alias("order_key"))
    return out.select("_mix_row.*")
