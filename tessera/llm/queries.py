"""Queries of the llm operators, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, overlap, spam, splits, tokens
from tessera.persist import cut, shared_dir
from tessera.plans.sqltext import greedy_sql
from tessera.tables import table


#: Rows from this year on, and the undated ones, come as the second batch of the component table.
LATE = 2020


def _components(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """All rows merged into a new component table in two batches, as they would arrive: the earlier years, then the rest."""
    store = splits.ComponentTable(spark, f"{shared_dir(spark)}/protein-components-{uuid.uuid4().hex}")
    early = F.coalesce(F.col("years").between(0, LATE - 1), F.lit(False))
    store.extend(rows.where(early))
    return store.extend(rows.where(~early))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Proteins tied to a smaller one, with the smallest of their block."""
    of = _components(spark, table(spark, d, "indexed_rows"))
    return of.where("kind = 'protein' and id <> component").select(F.col("component").alias("block_protein_id"), F.col("id").alias("protein_id"))


def p1_one_shot(spark: SparkSession, d: str) -> DataFrame:
    """The same from all rows at once, to compare."""
    of = splits.grow(table(spark, d, "indexed_rows"))
    return of.where("kind = 'protein' and id <> component").select(F.col("component").alias("block_protein_id"), F.col("id").alias("protein_id"))


def _sizes(units: DataFrame) -> DataFrame:
    return units.groupBy("unit_kind", "unit").agg(F.count("*").alias("rows"))


def _split_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "indexed_rows")
    u = splits.units(rows, _components(spark, rows))
    return u, splits.assign(_sizes(u))


def p1_assign(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its split."""
    u, a = _split_rows(spark, d)
    return u.join(a.select("unit_kind", "unit", "split"), ["unit_kind", "unit"]).select(F.col("_row").alias("row_id"), "split")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, share and years of each split."""
    return splits.report(*_split_rows(spark, d))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and units that each split gets."""
    return splits.report(*_split_rows(spark, d)).select("split", "n_rows", "n_units")


def p1_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Rows split, and proteins and scaffolds in two splits, which should be none."""
    rows = table(spark, d, "indexed_rows").select("row_id", "protein_ids", splits.scaffold(F.col("scaffold_groups")).alias("scaffold_groups"))
    s = cut(rows.join(p1_assign(spark, d), "row_id"), "split")
    many = lambda c: s.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b"))).scalar()
    return s.agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids")).select("*", many("protein_ids").alias("n_proteins_in_two"), many("scaffold_groups").alias("n_scaffolds_in_two"))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The earlier rows are split first, the later and undated ones added: units and rows by outcome."""
    rows = table(spark, d, "indexed_rows")
    store = splits.ComponentTable(spark, f"{shared_dir(spark)}/protein-components-{uuid.uuid4().hex}")
    is_early = F.coalesce(F.col("years").between(0, LATE - 1), F.lit(False))
    early = rows.where(is_early)
    a = splits.assign(_sizes(splits.units(early, store.extend(early))))
    now = store.extend(rows.where(~is_early))
    b = splits.assign(_sizes(splits.units(rows, now)), placed=splits.relabel(a, now))
    return b.groupBy("state", "split").agg(F.count("*").alias("n_units"), F.sum("rows").alias("n_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "prepared_rows"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an overlap, the class of equal ones they are in, and how many rows of the other side they meet."""
    return overlap.links(table(spark, d, "prepared_rows"))


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.coverage(table(spark, d, "prepared_rows"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "prepared_rows"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's digest after encoding and decoding; null texts come back as empty ones."""
    back = tokens.decode(tokens.encode(table(spark, d, "documents")))
    return back.select("doc_id", F.md5("text").alias("digest"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    texts = mixing.sized_texts(table(spark, d, "documents"), targets)
    planned = cut(mixing.plan(texts, targets), "plan")
    return planned, mixing.draw(texts, planned)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Listed sources too small for their share however often their texts may be repeated."""
    return mixing.report(*_mixed(spark, d)).where("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: each text once per use."""
    return mixing.mix(_mixed(spark, d)[1])


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """What each source contributes."""
    return mixing.report(*_mixed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages most of whose text is keywords, lists or links."""
    return spam.spam_pages(table(spark, d, "documents")).where("spam").select("doc_id")


def p8_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Pages and spam pages of each host."""
    s = spam.spam_pages(table(spark, d, "documents")).where("host is not null")
    return s.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if("spam").alias("n_spam"))


QUERIES = {f.__name__: f for f in (p1_found, p1_one_shot, p1_assign, p1_report, p1_shares, p1_leaks, p1_incremental, p5_found, p5_links, p5_coverage, p5_report, p6_ids, p6_round_trip, p7_found, p7_mix, p7_report, p8_found, p8_hosts)}

# The closure of all ties within blocks, then the smallest: fit for small tables.
_ROOTS = """t AS (SELECT DISTINCT protein_ids AS p, scaffold_groups AS s FROM indexed_rows WHERE protein_ids IS NOT NULL), h AS (SELECT s, min(p) AS hub FROM t WHERE s >= 0 GROUP BY s),
    e AS (SELECT DISTINCT hub AS a, p AS b FROM t JOIN h ON t.s = h.s WHERE hub <> p UNION SELECT DISTINCT p, hub FROM t JOIN h ON t.s = h.s WHERE hub <> p),
    r AS (SELECT DISTINCT p, p AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.p AND r.root <= e.b),
    c AS (SELECT p, min(root) AS block FROM r GROUP BY p)"""
_FOUND = f"WITH RECURSIVE {_ROOTS} SELECT block AS block_protein_id, p AS protein_id FROM c WHERE block <> p"
_UNITS = "SELECT count(*) AS n FROM indexed_rows i LEFT JOIN c ON i.protein_ids = c.p LEFT JOIN (SELECT h.s, block FROM h JOIN c ON h.hub = c.p) g ON i.scaffold_groups = g.s GROUP BY coalesce('c' || c.block, 'c' || g.block, CASE WHEN scaffold_groups >= 0 THEN 's' || scaffold_groups ELSE 'r' || row_id END)"

SQL: dict[str, str] = {
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p1_found": _FOUND,
    "p1_one_shot": _FOUND,
    "p1_shares": greedy_sql(_UNITS, splits.SPLITS, before=_ROOTS, name="split"),
    "p1_leaks": "SELECT count(*) AS n_rows, count(DISTINCT row_id) AS n_ids, 0::BIGINT AS n_proteins_in_two, 0::BIGINT AS n_scaffolds_in_two FROM indexed_rows",
}
