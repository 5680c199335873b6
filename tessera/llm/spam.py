"""Keyword-stuffed and link-list pages: bagged trees on content and link features, smoothed by host, then checked."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import pages
from tessera.persist import cut, cut_counting

#: Shorter pages are never cases.
MIN_CHARS = 100
#: More than this share of a case is neither sentences nor data; so are weak labels.
MOST = 0.5
#: Bound of the labelled sample the trees are fitted on: about so many pages, by hash of their key. Everything else runs
#: over all pages.
SAMPLE = 20_000
TREES, DEPTH, BINS, SEED = 30, 12, 64, 42
#: Pages whose smoothed vote is above this are read whole for the last check.
DOUBT = 0.01
#: A host counts as much as HOST_WEIGHT of the evidence of its other pages, of which HOST_PRIOR are taken to
#: be as all pages are.
HOST_WEIGHT, HOST_PRIOR = 0.25, 10.0


def host(url: Column) -> Column:
    """Host of a URL in lower case, null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@\s]*@)?([^/:?#\s]+)", 1))
    return F.when(h != "", h)


def long_enough(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.length(text) >= MIN_CHARS).select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))


def page_features(docs: DataFrame, key: str = "doc_id", text: str = "text", url: str = "url") -> tuple[DataFrame, int]:
    """``(key, host, f)`` of each page of at least MIN_CHARS characters, written to the shared folder, and their number.

    Content and links are counted page by page; from all pages' links comes the graph of hosts, whose feature is the
    number of pages of other hosts that link to the page's host. Null and short texts are left out: they are never cases.
    """
    base = docs.where(F.length(text) >= MIN_CHARS).select(F.col(key).cast("bigint").alias(key), host(F.col(url)).alias("host"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pages.content(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=[key, "host", "f", "to"])

    made, n = cut_counting(base.mapInArrow(run, f"`{key}` bigint, host string, f array<double>, to array<string>"), F.count("*"), "pages")
    # Only hosts that pages lie on count, so the table joined back is of those that are linked to among them.
    own = made.where("host is not null").select(F.col("host").alias("_to")).distinct()
    links = made.select(F.col("host").alias("_from"), F.explode("to").alias("_to")).where("_from is null or _from <> _to")
    inward = cut(links.groupBy("_to").agg(F.count("*").alias("_in")).join(own, "_to", "left_semi"), "inward")
    return made.join(inward, made["host"] == inward["_to"], "left").select(key, "host", F.concat("f", F.array(F.log1p(F.coalesce("_in", F.lit(0)).cast("double")))).alias("f")), n


def read_shares(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, neither)`` of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pages.shares(t)[2] for t in b.column(1).to_pylist()], pa.float64())], names=[key, "neither"])

    return texts.select(key, "text").mapInArrow(run, f"`{key}` bigint, neither double")


def fit(docs: DataFrame, featured: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> RandomForestClassificationModel | None:
    """Trees, each on a bootstrap sample, with a third of the features at each node; None where the sample hasn't both labels.

    Weak labels come from the shares of sentences and data, which are no features.
    """
    part = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1_000_000)) < SAMPLE * 1_000_000 / max(n, 1)
    # Parted by number, as reading texts is work, not bytes.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labelled = read_shares(long_enough(docs, key, text).where(part).repartition(parts), key).select(F.col(key).alias("_key"), (F.col("neither") > MOST).cast("double").alias("label"))
    sample = cut(featured.where(part).join(labelled, F.col(key).eqNullSafe(F.col("_key"))).select("label", array_to_vector("f").alias("features")), "sample")
    if sample.select("label").distinct().count() < 2:
        return None
    trees = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=SEED, bootstrap=True, maxBins=BINS)
    return trees.fit(sample)


def score(featured: DataFrame, model: RandomForestClassificationModel | None, key: str = "doc_id") -> DataFrame:
    """``(key, host, p)``: the trees' vote, or 0.5 where there is no model, which leaves all pages to the last check."""
    if model is None:
        return featured.select(key, "host", F.lit(0.5).alias("p"))
    voted = model.transform(featured.withColumn("features", array_to_vector("f")))
    return voted.select(key, "host", F.element_at(vector_to_array("probability"), 2).alias("p"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))
    return F.log(q / (1 - q))


def smooth(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, host, p, smoothed)``: log-odds moved towards those of the host's other pages.

    Hosts are summed before they are joined, so a host with any share of the pages is one row. A page
    without host, or alone on its host, keeps its vote.
    """
    all_pages = scored.agg(F.avg("p").alias("g"))
    base = all_pages.scalar()
    by = scored.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    j = scored.join(by, "host", "left").withColumn("g", base)
    rest = (F.col("s") - F.col("p") + HOST_PRIOR * F.col("g")) / (F.col("n") - 1 + HOST_PRIOR)
    moved = _logit(F.col("p")) + HOST_WEIGHT * (_logit(rest) - _logit(F.col("g")))
    return j.select(key, "host", "p", F.when(F.col("n").isNotNull(), 1 / (1 + F.exp(-moved))).otherwise(F.col("p")).alias("smoothed"))


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", url: str = "url") -> DataFrame:
    """``(key, host, p, smoothed, neither, spam)`` of every page of at least MIN_CHARS characters.

    ``spam`` is true where the smoothed vote is above DOUBT and the check of the whole text agrees: more than half is neither
    sentences nor data. ``neither`` is null for pages below DOUBT, which aren't read again. Copies of a page get the same
    vote. Other columns aren't carried; an empty table gives an empty result.
    """
    featured, n = page_features(docs, key, text, url)
    voted = cut(smooth(cut(score(featured, fit(docs, featured, n, key, text), key), "scored"), key), "voted")
    # Written, so that the optimizer knows its size before it reads texts and ships it where it is small.
    doubtful = cut(voted.where(F.col("smoothed") > DOUBT).select(F.col(key).alias("_key")).distinct(), "doubtful")
    texts = long_enough(docs, key, text).join(doubtful, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    read = read_shares(texts, key).groupBy(F.col(key).alias("_key")).agg(F.max("neither").alias("neither"))
    j = voted.join(read, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return j.select(key, "host", "p", "smoothed", "neither", F.coalesce(F.col("neither") > MOST, F.lit(False)).alias("spam"))
