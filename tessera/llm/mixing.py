"""Sources mixed to target shares of the tokens by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.operators.parse import strip
from tessera.operators.prefix import hash_slot, running_sum
from tessera.persist import cut

#: Expected copies are whole numbers of this many parts, so that running sums are exact in any order.
PARTS = 1 << 20
SEED = 42


def source_name(c):  # noqa: ANN001, ANN201
    return F.lower(strip(c))


def sized_texts(docs: DataFrame, targets: DataFrame, **tokenizer: str) -> DataFrame:
    """Distinct texts of the listed sources: ``(source, text_key, doc_id, copies, n_tokens)``.

    Documents with the same text in one source are one text, so that repeats count per text. Written to
    the shared folder. Documents without source or of unlisted ones have share 0 and stay out; empty and
    null texts have no tokens and nothing to repeat.
    """
    known = targets.select(source_name(F.col("source")).alias("source")).distinct()
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text")).join(known, "source", "left_semi")
    size = tokens.count_tokens(own, "doc_id", "text", **tokenizer)
    keyed = own.select("doc_id", "source", F.md5("text").alias("text_key"))
    joined = keyed.join(size, "doc_id")
    return cut(joined.where("n_tokens > 0").groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_tokens").alias("n_tokens")), "sized")


def plan(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: its size, the tokens wanted, the factor its texts are repeated by.

    The total is that of all listed sources. A text that a source holds ``k`` times is expected
    ``min(max_repeats, factor * k)`` times; the factor is solved from the tokens by ``k``, of which there
    are few.
    """
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"))
    by = texts.groupBy("source", "copies").agg(F.sum("n_tokens").alias("tokens"))
    size = by.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("size_tokens"))
    base = t.join(size, "source", "left").withColumn("size_tokens", F.coalesce("size_tokens", F.lit(0)))
    base = base.withColumn("total_tokens", F.sum("size_tokens").over(Window.partitionBy(F.lit(0))))
    base = base.withColumn("wanted_tokens", F.col("target_share") * F.col("total_tokens"))
    # From the most repeated texts down: those above are capped, the rest share what is left.
    down = Window.partitionBy("source").orderBy(F.desc("copies")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy("copies").rowsBetween(Window.unboundedPreceding, 0)
    steps = by.join(base, "source").withColumns({"capped": F.coalesce(F.sum("tokens").over(down), F.lit(0)), "free": F.sum(F.col("tokens") * F.col("copies")).over(up)})
    steps = steps.withColumn("f", (F.col("wanted_tokens") - F.col("max_repeats") * F.col("capped")) / F.col("free"))
    fits = steps.where((F.col("f") >= 0) & (F.col("f") * F.col("copies") <= F.col("max_repeats")))
    factor = fits.groupBy("source").agg(F.max(F.struct("copies", "f")).alias("b")).select("source", F.col("b.f").alias("factor"))
    out = base.join(factor, "source", "left").withColumn("factor", F.coalesce("factor", F.col("max_repeats").cast("double")))
    return out


def draw(texts: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """``(source, doc_id, n_tokens, copies, repeats)``: how often each text is used, by systematic sampling.

    Within a source the expected copies are summed, one random offset is added, and a text is used once for each whole
    number its stretch of the sum crosses: never more than its expectation rounded up. Texts are summed by size, in
    steps of a fifth, and within those by hash, so that sizes are drawn in proportion and the source's tokens come right to
    about one of its largest texts. The sum runs in slots of size and hash, so no task holds a source.
    """
    few = planned.select("source", "max_repeats", "factor")
    e = F.least(F.col("max_repeats") * F.lit(PARTS), F.floor(F.col("factor") * F.col("copies") * F.lit(float(PARTS)))).cast("bigint")
    want = texts.join(few, "source").withColumns({"expected": e, "h": F.xxhash64("text_key", F.lit(seed))})
    # Slots fall along size first, hash second; hash_slot counts from -512 to 511.
    slot = F.floor(F.log2("n_tokens") * 4) * 1024 + hash_slot(F.col("h"))
    summed = running_sum(want, ["source"], {"before": F.col("expected")}, slot, ["h", "text_key"])
    start = F.col("before") + F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(PARTS))
    crossed = F.floor((start + F.col("expected")) / F.lit(PARTS)) - F.floor(start / F.lit(PARTS))
    return summed.select("source", "doc_id", "n_tokens", "copies", crossed.cast("int").alias("repeats"))


def mix(drawn: DataFrame) -> DataFrame:
    """One row per use of a text: ``(source, doc_id, use)``."""
    return drawn.where("repeats > 0").select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("use"))


def report(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """What each listed source contributes in fact: tokens, share of the mix, and if it was short.

    A source is short where the mix has less of it than wanted and would have less even with every document at
    ``max_repeats``. What short sources lack isn't given to others, so ``over_target`` tells what a source has more of the
    mix than its target.
    """
    used = drawn.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("mixed_tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("held_tokens"), F.max("repeats").alias("most_repeats"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("mixed_tokens", "held_tokens", "most_repeats")}
    out = planned.join(used, "source", "left").withColumns(zero)
    short = (F.col("mixed_tokens") < F.col("wanted_tokens")) & (F.col("max_repeats") * F.col("held_tokens") < F.col("wanted_tokens"))
    share = F.try_divide(F.col("mixed_tokens"), F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))
    got = out.select("source", "target_share", "max_repeats", "size_tokens", "wanted_tokens", "mixed_tokens", "most_repeats", share.alias("reached_share"), short.alias("short"))
    return got.withColumn("over_target", F.col("reached_share") - F.col("target_share"))
