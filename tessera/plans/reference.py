"""Queries for the operators over activity tables, each with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import balance, build, eager, features, folds, losses, metrics, prepare, vocab
from tessera.persist import cut
from tessera.plans.sqltext import greedy_sql
from tessera.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


# Pieces of SQL shared below. White space is that of Python's str.strip; texts are trimmed of it.
_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"


def _t(c: str) -> str:
    return f"trim({c}, {_WS})"


def _num(c: str) -> str:
    v = f"try_cast({_t(c)} AS DOUBLE)"
    return f"(CASE WHEN regexp_full_match({_t(c)}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND isfinite({v}) THEN {v} END)"


def _nm(c: str) -> str:
    return f"(CASE WHEN NOT regexp_matches({c}, '[<>]') AND {_num(c)} > 0 THEN {_num(c)} END)"


_LONG = " UNION ALL ".join(f"SELECT pair_id, '{a}' AS assay_type, {i} AS assay_order, {_nm(c)} AS nm, target_name, activity_label FROM prepared_pairs" for i, (a, c) in enumerate(prepare.WIDE.items()))
_NAME = "nullif(trim(regexp_replace(lower({c}), '[\\s]+', ' ', 'g')), '')"
_LABEL = f"(CASE WHEN lower({_t('activity_label')}) IN ('1','1.0','y','active','true') THEN 1 WHEN lower({_t('activity_label')}) IN ('0','0.0','n','inactive','false') THEN 0 WHEN {_num('activity_label')} = 1 THEN 1 WHEN {_num('activity_label')} = 0 THEN 0 END)"
_BIN = "(CASE WHEN nm < 10 THEN 0 WHEN nm < 100 THEN 1 WHEN nm < 1000 THEN 2 WHEN nm < 10000 THEN 3 ELSE 4 END)"


@query(
    f"""SELECT target_name, count(*) AS n, CAST(sum(active) AS BIGINT) AS n_active, CAST(sum(1 - active) AS BIGINT) AS n_inactive, round(avg(p), 6) AS mean_pactivity FROM (
    SELECT {_NAME.format(c='target_name')} AS target_name, -log10(nm * 1e-9) AS p, coalesce(CASE WHEN {_LABEL} = 1 THEN 1 WHEN {_LABEL} = 0 THEN 0 END, CASE WHEN -log10(nm * 1e-9) >= 5 THEN 1 ELSE 0 END) AS active FROM ({_LONG}) WHERE nm IS NOT NULL)
    WHERE target_name IS NOT NULL GROUP BY target_name"""
)
def target_activity(spark: SparkSession, d: str) -> DataFrame:
    """Unpivot, parse, label and count actives per target."""
    pairs = table(spark, d, "prepared_pairs").withColumns({"target": eager.norm_name(F.col("target_name")), "label": S.activity_label(F.col("activity_label"))})
    long = prepare.unpivot_assays(pairs, ["target", "label"]).withColumn("active", S.labelled_active(F.col("label"), F.col("pactivity")))
    out = long.where("target is not null").groupBy("target").agg(F.count("*").alias("n"), F.sum(F.col("active").cast("bigint")).alias("n_active"), F.sum((1 - F.col("active")).cast("bigint")).alias("n_inactive"), F.round(F.avg("pactivity"), 6).alias("mean_pactivity"))
    return out.withColumnRenamed("target", "target_name")


@query(f"SELECT pair_id, assay_type, assay_order, nm, round(-log10(nm * 1e-9), 6) AS pactivity FROM ({_LONG}) WHERE nm IS NOT NULL")
def assay_unpivot(spark: SparkSession, d: str) -> DataFrame:
    long = prepare.unpivot_assays(table(spark, d, "prepared_pairs"), ["pair_id"])
    return long.withColumn("pactivity", F.round("pactivity", 6))


@query(
    f"""SELECT pair_id, coalesce(CASE WHEN {_num('ph')} BETWEEN 0 AND 14 THEN {_num('ph')} END, 7.4) AS ph,
    coalesce(CASE WHEN {_num("rtrim(" + _t('temp_c') + ", 'Cc')")} BETWEEN -80 AND 100 THEN {_num("rtrim(" + _t('temp_c') + ", 'Cc')")} END, 25.0) AS temp,
    CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS year, {_LABEL} AS label FROM prepared_pairs"""
)
def parse_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions, year and label of each prepared pair, defaults filled."""
    t = table(spark, d, "prepared_pairs")
    return t.select("pair_id", F.coalesce(S.ph(F.col("ph")), F.lit(S.DEFAULT_PH)).alias("ph"), F.coalesce(S.temperature(F.col("temp_c")), F.lit(S.DEFAULT_TEMP)).alias("temp"), S.year(F.col("year")).alias("year"), S.activity_label(F.col("activity_label")).alias("label"))


@query(f"SELECT assay_type, {_BIN} AS bin, count(*) AS n FROM ({_LONG}) WHERE nm IS NOT NULL GROUP BY 1, 2")
def potency_bins(spark: SparkSession, d: str) -> DataFrame:
    long = prepare.unpivot_assays(table(spark, d, "prepared_pairs"), [])
    return long.groupBy("assay_type", S.potency_bin(F.col("nm")).alias("bin")).agg(F.count("*").alias("n"))


_CLASS = f"CASE WHEN lower({_t('activity_label')}) IN ('y','yes','active','1','true') THEN 1 WHEN lower({_t('activity_label')}) IN ('n','no','inactive','0','false') THEN 0 END"


@query(f"SELECT {_CLASS} AS class, coalesce(lower({_t('activity_label')}) IN ('1','1.0','true','yes'), false) AS flag, count(*) AS n FROM prepared_pairs GROUP BY 1, 2")
def class_and_flag(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("activity_label")
    return table(spark, d, "prepared_pairs").groupBy(S.activity_class(c).alias("class"), S.flag(c).alias("flag")).agg(F.count("*").alias("n"))


_ASSAY = "CASE {c} WHEN 'Ki' THEN 'Ki' WHEN 'Kd' THEN 'Kd' WHEN 'IC50' THEN 'IC50' WHEN 'EC50' THEN 'EC50' WHEN 'Potency' THEN 'Other' WHEN 'AC50' THEN 'Other' WHEN 'ED50' THEN 'Other' WHEN 'XC50' THEN 'Other' END"
_REASON = f"""CASE WHEN coalesce({_t('standard_relation')}, '') <> '=' THEN 'relation' WHEN coalesce({_t('standard_units')}, '') <> 'nM' THEN 'units'
    WHEN {_ASSAY.format(c=_t('standard_type'))} IS NULL THEN 'type' WHEN coalesce({_num('standard_value')}, 0) <= 0 THEN 'value'
    WHEN coalesce({_t('accession')}, '') = '' THEN 'accession' WHEN coalesce({_t('parent_molecule_chembl_id')}, '') = '' THEN 'ligand' END"""
_FILLED = "nullif(CASE WHEN lower({t}) <> 'nan' THEN {t} END, '')"


@query(
    f"""WITH dim AS (SELECT upper({_t('accession')}) AS accession, arg_max(struct_pack(n := {_FILLED.format(t=_t('tid'))}, s := {_FILLED.format(t=_t('chain_sequence'))}), record_id) AS b FROM proteins
    WHERE accession IS NOT NULL AND {_FILLED.format(t=_t('chain_sequence'))} IS NOT NULL GROUP BY 1)
    SELECT row_id, dim.accession, coalesce(b.n, coalesce({_t('entry_name')}, '')) AS name, {_t('parent_molecule_chembl_id')} AS ligand, {_ASSAY.format(c=_t('standard_type'))} AS assay_type, {_num('standard_value')} AS nm, CAST(length(b.s) AS INTEGER) AS chain_length
    FROM gpcrdb_data g JOIN dim ON upper({_t('g.accession')}) = dim.accession WHERE ({_REASON.replace("accession", "g.accession")}) IS NULL"""
)
def gpcr_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Raw export filtered, typed and joined with its protein; the entry's name where the protein has none."""
    return prepare.gpcr_pairs(table(spark, d, "gpcrdb_data"), table(spark, d, "proteins"))


@query(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM gpcrdb_data GROUP BY 1")
def skip_counters(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "gpcrdb_data")
    return prepare.counts_by_reason(raw, prepare.gpcr_reason(raw))


@query(
    f"""SELECT target_id, b.n AS name, b.o AS organism, CAST(length(b.s) AS INTEGER) AS chain_length FROM (SELECT target_id, arg_max(struct_pack(n := coalesce({_FILLED.format(t=_t('tid'))}, {_FILLED.format(t=_t('accession'))}, target_id), o := coalesce({_t('organism')}, ''), s := {_FILLED.format(t=_t('chain_sequence'))}), record_id) AS b
    FROM proteins WHERE target_id IS NOT NULL AND {_FILLED.format(t=_t('chain_sequence'))} IS NOT NULL GROUP BY target_id)"""
)
def protein_dimension(spark: SparkSession, d: str) -> DataFrame:
    return prepare.protein_dimension(table(spark, d, "proteins")).select("target_id", "name", "organism", F.length("sequence").alias("chain_length"))


@query(f"SELECT sequence, arg_min(target_id, record_id) AS target_id, count(DISTINCT target_id) AS n_targets FROM (SELECT record_id, target_id, {_FILLED.format(t=_t('chain_sequence'))} AS sequence FROM proteins) WHERE sequence IS NOT NULL AND target_id IS NOT NULL GROUP BY sequence")
def sequence_dimension(spark: SparkSession, d: str) -> DataFrame:
    return prepare.sequence_dimension(table(spark, d, "proteins"))


@query(
    f"""SELECT protein_id, t AS token FROM (SELECT DISTINCT protein_id, unnest(list_transform(string_split(classification, ';'), lambda p: list_filter(list_transform(string_split(p, '->'), lambda x: {_t('x')}), lambda x: x <> '')[2])) AS t
    FROM proteins WHERE lower({_t('classification')}) <> 'nan') WHERE t IS NOT NULL"""
)
def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Second-level tokens of the classification paths."""
    return table(spark, d, "proteins").select("protein_id", F.explode(S.path_tokens(F.col("classification"), 2)).alias("token")).distinct()


@query(
    """WITH l AS (SELECT n_regionkey AS k, list(n_name ORDER BY n_name) AS a, list(n_nationkey ORDER BY n_name) AS b FROM nation GROUP BY 1), m AS (SELECT k, a, list_slice(b, 1, 3) AS b FROM l)
    SELECT k AS region, CAST(i AS INTEGER) AS item, a[i + 1] AS name, CAST(b[least(i + 1, len(b))] AS VARCHAR) AS code FROM m, unnest(range(0, len(a))) AS t(i)"""
)
def multi_explode(spark: SparkSession, d: str) -> DataFrame:
    """Aligned explode of two lists of unequal length, the shorter padded with its last item."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("l"))
    lists = n.select(F.col("n_regionkey").alias("region"), F.array_join(F.col("l.n_name"), ";").alias("name"), F.array_join(F.slice(F.col("l.n_nationkey"), 1, 3).cast("array<string>"), ";").alias("code"))
    return prepare.explode_lists(lists, ["name", "code"], ["region"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE (CASE left(o_orderpriority, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END) IN ('medium', 'high') GROUP BY 1")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    tier = F.when(first.isin("1", "2"), "high").when(first == "3", "medium").otherwise("low")
    return table(spark, d, "orders").where(S.quality_at_least(tier, "medium")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT protein_ids, first, row_number() OVER (ORDER BY first) - 1 AS idx FROM (SELECT protein_ids, min(row_id) AS first FROM indexed_rows GROUP BY 1)")
def first_seen_ids(spark: SparkSession, d: str) -> DataFrame:
    return prepare.dense_ids(table(spark, d, "indexed_rows"), "protein_ids", "row_id", "idx")


def _families(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins").select("record_id", "protein_id", "target_id", S.path_tokens(F.col("classification"), 2).alias("families"))
    one = prepare.last_by(p, "protein_id", "record_id", ["target_id", "families"])
    return one.select(F.col("protein_id").alias("protein_ids"), F.col("target_id").alias("target"), "families")


def _sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_rows").where("activity_labels = 1")
    return vocab.label_sets(rows, _families(spark, d), "ligand_ids", "protein_ids", "years")


_SETS = f"""p AS (SELECT protein_id, arg_max(struct_pack(t := target_id, f := CASE WHEN lower({_t('classification')}) <> 'nan' THEN list_sort(list_distinct(list_filter(list_transform(string_split(classification, ';'), lambda p: list_filter(list_transform(string_split(p, '->'), lambda x: {_t('x')}), lambda x: x <> '')[2]), lambda x: x IS NOT NULL))) ELSE [] END), record_id) AS b FROM proteins GROUP BY 1),
    s AS (SELECT ligand_ids, list_sort(list_distinct(flatten(list(b.f)))) AS families, list_sort(list_distinct(list_filter(list(b.t), lambda x: x IS NOT NULL))) AS targets, max(CASE WHEN years >= 0 THEN years END) AS year FROM indexed_rows JOIN p ON protein_ids = protein_id WHERE activity_labels = 1 AND ligand_ids IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_SETS} SELECT ligand_ids, array_to_string(families, '|') AS families, array_to_string(targets, '|') AS targets, year FROM s")
def ligand_labels(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d).withColumns({c: F.array_join(c, "|") for c in ("families", "targets")})


def _vocab_sql(labels: str, least: int, top: int | None) -> str:
    cap = f"WHERE idx < {top}" if top else ""
    return f"SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY n_active DESC, label) - 1 AS INTEGER) AS idx, label, n_active FROM (SELECT label, count(*) AS n_active FROM (SELECT unnest({labels}) AS label FROM s) GROUP BY 1 HAVING count(*) >= {least})) {cap}"


@query(f"WITH {_SETS} {_vocab_sql('families', 20, None)}")
def family_vocab(spark: SparkSession, d: str) -> DataFrame:
    return vocab.vocabulary(_sets(spark, d), "families", 20)


@query(f"WITH {_SETS} {_vocab_sql('targets', 5, 32)}")
def target_vocab(spark: SparkSession, d: str) -> DataFrame:
    return vocab.vocabulary(_sets(spark, d), "targets", 5, 32)


@query(f"WITH {_SETS}, v AS ({_vocab_sql('targets', 5, 32)}), w AS (SELECT list(label ORDER BY idx) AS l FROM v) SELECT ligand_ids, array_to_string(list_transform(w.l, lambda x: CAST(CAST(list_contains(targets, x) AS INTEGER) AS VARCHAR)), '') AS hot FROM s, w")
def multi_hot(spark: SparkSession, d: str) -> DataFrame:
    sets = cut(_sets(spark, d), "sets")
    return vocab.multi_hot(sets, "ligand_ids", "targets", vocab.vocabulary(sets, "targets", 5, 32)).withColumn("hot", F.array_join("hot", ""))


@query(f"WITH {_SETS}, v AS ({_vocab_sql('targets', 5, 32)}), w AS (SELECT list(label) AS l FROM v) SELECT count(*) AS n_ligands, CAST(sum(len(list_intersect(targets, w.l))) AS BIGINT) AS n_labels, round(avg(len(list_intersect(targets, w.l))), 6) AS mean_labels FROM s, w WHERE len(list_intersect(targets, w.l)) > 0")
def labels_per_ligand(spark: SparkSession, d: str) -> DataFrame:
    """Ligands left after the vocabulary filter, and their mean number of labels."""
    sets = cut(_sets(spark, d), "sets")
    kept = vocab.keep_known(sets, "targets", vocab.vocabulary(sets, "targets", 5, 32))
    return kept.agg(F.count("*").alias("n_ligands"), F.sum(F.size("targets").cast("bigint")).alias("n_labels"), F.round(F.avg(F.size("targets")), 6).alias("mean_labels"))


_YEAR = "coalesce(CASE WHEN years >= 0 THEN years END, -1)"


@query(
    f"""WITH t AS (SELECT * FROM indexed_rows WHERE {_YEAR} < 2022) SELECT row_id, protein_ids IN (SELECT protein_ids FROM t) AS protein_known, coalesce(scaffold_groups >= 0 AND scaffold_groups IN (SELECT scaffold_groups FROM t WHERE scaffold_groups >= 0), false) AS scaffold_known FROM indexed_rows WHERE {_YEAR} >= 2022"""
)
def known_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether protein and scaffold of the rows since 2022 occur in earlier or undated ones."""
    return _known(spark, d).select("row_id", "protein_known", "scaffold_known")


def _known(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_rows").withColumn("_y", folds.dated(F.col("years")))
    old, new = rows.where("_y < 2022"), rows.where("_y >= 2022")
    p = old.select(F.col("protein_ids").alias("_p")).distinct().withColumn("_kp", F.lit(True))
    s = old.where("scaffold_groups >= 0").select(F.col("scaffold_groups").alias("_s")).distinct().withColumn("_ks", F.lit(True))
    j = new.join(p, F.col("protein_ids") == F.col("_p"), "left").join(s, F.col("scaffold_groups") == F.col("_s"), "left")
    return j.withColumns({"protein_known": F.coalesce("_kp", F.lit(False)), "scaffold_known": F.coalesce("_ks", F.lit(False))})


@query(f"SELECT row_id FROM indexed_rows WHERE {_YEAR} >= 2022 AND protein_ids NOT IN (SELECT protein_ids FROM indexed_rows WHERE {_YEAR} < 2022 AND protein_ids IS NOT NULL)")
def unseen_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_rows").withColumn("_y", folds.dated(F.col("years")))
    return rows.where("_y >= 2022 and protein_ids is not null").join(rows.where("_y < 2022").select("protein_ids"), "protein_ids", "left_anti").select("row_id")


@query("SELECT n_nationkey, r_name, r_regionkey FROM nation CROSS JOIN region")
def every_pair(spark: SparkSession, d: str) -> DataFrame:
    """Each row with each of a short list."""
    return features.every_pair(table(spark, d, "nation").select("n_nationkey"), table(spark, d, "region").select("r_name", "r_regionkey"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return prepare.union_all([c, s])


@query("SELECT sha1(accession) AS key, accession FROM (SELECT DISTINCT accession FROM documents WHERE accession IS NOT NULL) WHERE accession NOT IN (SELECT accession FROM gpcrdb_data WHERE accession IS NOT NULL)")
def cache_miss(spark: SparkSession, d: str) -> DataFrame:
    """Proteins written about whose key isn't among those measured."""
    cached = table(spark, d, "gpcrdb_data").where("accession is not null").select(F.sha1(F.col("accession").cast("binary")).alias("key")).distinct()
    return features.cache_misses(table(spark, d, "documents").select("accession"), cached, "accession", "key")


# Scores for the metrics: of a hundred values, so with many ties.
_SCORED = "SELECT row_id, protein_ids, activity_labels AS y, ((row_id * 7919 + activity_labels * 20) % 101) / 100.0::DOUBLE AS s, years, scaffold_groups, assay_idx FROM indexed_rows"


def _scored(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"y": F.col("activity_labels"), "s": (F.col("row_id") * 7919 + F.col("activity_labels") * 20) % 101 / F.lit(100.0)})


def _metrics_sql(source: str, group: str) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""WITH c AS (SELECT {g} s, sum(y) AS p, sum(1 - y) AS q FROM ({source}) GROUP BY {g} s),
    w AS (SELECT *, sum(p) OVER ({part}) AS np, sum(q) OVER ({part}) AS nq, coalesce(sum(p) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb, coalesce(sum(q) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM c),
    a AS (SELECT {g} CAST(any_value(np) AS DOUBLE) AS np, CAST(any_value(nq) AS DOUBLE) AS nq, CAST(sum(p * (qb + q / 2.0)) AS DOUBLE) AS area, CAST(sum(CASE WHEN p > 0 THEN p * (np - pb)::DOUBLE / (np - pb + nq - qb) ELSE 0 END) AS DOUBLE) AS ap, CAST(sum(CASE WHEN s >= 0.5 THEN p ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN s >= 0.5 THEN q ELSE 0 END) AS DOUBLE) AS fp FROM w {'GROUP BY ' + group if group else ''}),
    m AS (SELECT {g} CAST(np + nq AS BIGINT) AS n, CAST(np AS BIGINT) AS n_pos, CAST(nq AS BIGINT) AS n_neg, CASE WHEN np > 0 AND nq > 0 THEN area / (np * nq) ELSE 0.5 END AS auroc, CASE WHEN np > 0 AND nq > 0 THEN ap / np ELSE np / (np + nq) END AS auprc, (tp + nq - fp) / (np + nq) AS accuracy,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + (np - tp) > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + (np - tp)) ELSE 0 END AS f1 FROM a)"""


_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.NAMES)


def _round(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({m: F.round(m, 6) for m in names})


@query(_metrics_sql(_SCORED, "") + f" SELECT n, n_pos, n_neg, {_ROUNDED} FROM m")
def pooled_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.pooled(_scored(table(spark, d, "indexed_rows")), "y", "s"), metrics.NAMES)


@query(_metrics_sql(_SCORED, "protein_ids") + f" SELECT protein_ids, n, n_pos, n_neg, {_ROUNDED} FROM m")
def per_target_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.binary_metrics(_scored(table(spark, d, "indexed_rows")), ["protein_ids"], "y", "s"), metrics.NAMES)


_MACRO = ", ".join(f"round(coalesce(avg(CASE WHEN n_pos > 0 AND n_neg > 0 THEN {m} END), {0.5 if m == 'auroc' else 0}), 6) AS macro_{m}" for m in metrics.NAMES)


@query(_metrics_sql(_SCORED, "protein_ids") + f" SELECT count(*) AS n_targets, count(*) FILTER (n_pos > 0 AND n_neg > 0) AS n_evaluable, count(*) FILTER (n_pos = 0 OR n_neg = 0) AS n_skipped, {_MACRO} FROM m")
def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    per = metrics.binary_metrics(_scored(table(spark, d, "indexed_rows")), ["protein_ids"], "y", "s")
    return _round(metrics.macro(per), [f"macro_{m}" for m in metrics.NAMES])


_KNOWN = f"""WITH t AS (SELECT * FROM indexed_rows WHERE {_YEAR} < 2022), k AS (SELECT activity_labels AS y, ((row_id * 7919 + activity_labels * 20) % 101) / 100.0::DOUBLE AS s, protein_ids, protein_ids IN (SELECT protein_ids FROM t) AS protein_known, coalesce(scaffold_groups >= 0 AND scaffold_groups IN (SELECT scaffold_groups FROM t WHERE scaffold_groups >= 0), false) AS scaffold_known FROM indexed_rows WHERE {_YEAR} >= 2022),"""
_CUBE = "SELECT y, s, a AS protein_known, b AS scaffold_known FROM k, unnest([k.protein_known, NULL]) AS x(a), unnest([k.scaffold_known, NULL]) AS z(b)"


@query(
    _KNOWN
    + _metrics_sql(_CUBE, "protein_known, scaffold_known")[5:]
    + f" SELECT f.a AS protein_known, f.b AS scaffold_known, coalesce(n, 0) AS n, coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg, {', '.join(f'CASE WHEN n_pos > 0 AND n_neg > 0 THEN round({x}, 6) END AS {x}' for x in metrics.NAMES)} FROM (SELECT a, b FROM (VALUES (true), (false), (NULL)) t(a), (VALUES (true), (false), (NULL)) u(b)) f LEFT JOIN m ON f.a IS NOT DISTINCT FROM m.protein_known AND f.b IS NOT DISTINCT FROM m.scaffold_known"
)
def novelty_cube(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.novelty_cube(_scored(_known(spark, d)), "y", "s", ("protein_known", "scaffold_known")), metrics.NAMES)


@query(
    _KNOWN
    + _metrics_sql("SELECT y, s, b AS bucket, protein_ids FROM k, unnest(['overall', CASE WHEN protein_known THEN 'known' ELSE 'unknown' END]) AS x(b)", "bucket, protein_ids")[5:]
    + f" SELECT bucket, count(*) AS n_targets, count(*) FILTER (n_pos > 0 AND n_neg > 0) AS n_evaluable, count(*) FILTER (n_pos = 0 OR n_neg = 0) AS n_skipped, {_MACRO} FROM m GROUP BY bucket"
)
def macro_by_novelty(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(_known(spark, d)).select("protein_ids", "y", "s", F.explode(F.array(F.lit("overall"), F.when(F.col("protein_known"), "known").otherwise("unknown"))).alias("bucket"))
    per = metrics.binary_metrics(rows, ["bucket", "protein_ids"], "y", "s")
    return _round(metrics.macro(per, ["bucket"]), [f"macro_{m}" for m in metrics.NAMES])


_LABEL_CELLS = "SELECT label, y, ((row_id * 7919 + label * 31 + y * 25) % 101) / 100.0::DOUBLE AS s FROM (SELECT row_id, l AS label, CASE WHEN assay_idx = l THEN 1 ELSE 0 END AS y FROM indexed_rows, range(0, 5) AS t(l))"


def _label_cells(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "indexed_rows").select("row_id", "assay_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("label"))
    y = F.when(F.col("assay_idx") == F.col("label"), 1).otherwise(0)
    return long.withColumn("y", y).withColumn("s", (F.col("row_id") * 7919 + F.col("label") * 31 + F.col("y") * 25) % 101 / F.lit(100.0))


@query(_metrics_sql(_LABEL_CELLS, "label") + " SELECT label, n, n_pos, round(n_pos / n, 6) AS active_frac, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(precision, 6) AS precision, round(recall, 6) AS recall, n_pos > 0 AND n_neg > 0 AS evaluable FROM m")
def per_label_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.binary_metrics(_label_cells(spark, d), ["label"], "y", "s")
    return _round(m.select("label", "n", "n_pos", (F.col("n_pos") / F.col("n")).alias("active_frac"), "auroc", "auprc", "precision", "recall", ((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).alias("evaluable")), ["active_frac", "auroc", "auprc", "precision", "recall"])


@query(_metrics_sql(_LABEL_CELLS, "") + " SELECT n, n_pos, round(auroc, 6) AS micro_auroc, round(auprc, 6) AS micro_auprc FROM m")
def micro_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.pooled(_label_cells(spark, d), "y", "s")
    return m.select("n", "n_pos", F.round("auroc", 6).alias("micro_auroc"), F.round("auprc", 6).alias("micro_auprc"))


@query(_metrics_sql(_LABEL_CELLS, "label") + " SELECT * FROM (SELECT 'best' AS side, label, round(auroc, 6) AS auroc FROM m WHERE n_pos > 0 AND n_neg > 0 ORDER BY m.auroc DESC, label LIMIT 2) UNION ALL SELECT * FROM (SELECT 'worst', label, round(auroc, 6) FROM m WHERE n_pos > 0 AND n_neg > 0 ORDER BY m.auroc, label LIMIT 2)")
def best_and_worst_labels(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.binary_metrics(_label_cells(spark, d), ["label"], "y", "s").where("n_pos > 0 and n_neg > 0")
    best, worst = m.orderBy(F.desc("auroc"), "label").limit(2), m.orderBy("auroc", "label").limit(2)
    return best.select(F.lit("best").alias("side"), "label", F.round("auroc", 6).alias("auroc")).unionByName(worst.select(F.lit("worst").alias("side"), "label", F.round("auroc", 6).alias("auroc")))


_HEADS = f"SELECT CASE assay_type WHEN 'IC50' THEN 0 ELSE 1 END AS head, {_BIN} AS t, least(4, {_BIN} + pair_id % 2) AS g FROM ({_LONG}) WHERE nm IS NOT NULL AND assay_type IN ('IC50', 'EC50')"


def _heads(spark: SparkSession, d: str) -> DataFrame:
    long = prepare.unpivot_assays(table(spark, d, "prepared_pairs"), ["pair_id"]).where("assay_type in ('IC50', 'EC50')")
    b = S.potency_bin(F.col("nm"))
    return long.select(F.when(F.col("assay_type") == "IC50", 0).otherwise(1).alias("head"), b.alias("t"), F.least(F.lit(4), b + (F.col("pair_id") % 2).cast("int")).alias("g"))


_CELLS = f"h AS ({_HEADS}), c AS (SELECT head, t, g, coalesce(n, 0) AS n FROM (SELECT DISTINCT head FROM h), range(0, 5) AS x(t), range(0, 5) AS y(g) LEFT JOIN (SELECT head AS hh, t AS tt, g AS gg, count(*) AS n FROM h GROUP BY ALL) ON hh = head AND tt = t AND gg = g)"


@query(f"WITH {_CELLS} SELECT head, CAST(t AS INTEGER) AS t, CAST(g AS INTEGER) AS g, n FROM c")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_heads(spark, d), "head", "t", "g", 5)


@query(
    f"""WITH {_CELLS}, b AS (SELECT head, range AS b, sum(CASE WHEN t = range AND g = range THEN n ELSE 0 END) AS tp, sum(CASE WHEN t = range THEN n ELSE 0 END) + sum(CASE WHEN g = range THEN n ELSE 0 END) AS bt FROM c, range(0, 5) GROUP BY 1, 2),
    f AS (SELECT head, sum(CASE WHEN bt > 0 THEN 2.0 * tp / bt ELSE 0 END) / 5 AS macro_f1 FROM b GROUP BY 1)
    SELECT c.head, CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN t = g THEN n ELSE 0 END) / sum(n), 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1, round(sum(n * abs(t - g)) / sum(n), 6) AS ordinal_mae FROM c JOIN f ON c.head = f.head GROUP BY c.head"""
)
def range_metrics(spark: SparkSession, d: str) -> DataFrame:
    cells = metrics.confusion(_heads(spark, d), "head", "t", "g", 5)
    return _round(metrics.head_metrics(cells, "head", "t", "g", 5), ["accuracy", "macro_f1", "ordinal_mae"])


_CUTS = """h AS (SELECT years AS y, count(*) AS n FROM indexed_rows WHERE years >= 0 GROUP BY 1), r AS (SELECT y, sum(n) OVER (ORDER BY y) AS cum, sum(n) OVER () AS n FROM h),
    v AS (SELECT val_year, greatest(val_year, test_year) AS test_year FROM (SELECT coalesce(min(y) FILTER (cum >= 0.7::DOUBLE * n), max(y)) AS val_year, coalesce(min(y) FILTER (cum >= 0.8::DOUBLE * n), max(y)) AS test_year FROM r))"""


@query(f"WITH {_CUTS} SELECT * FROM v")
def year_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return folds.year_cutoffs(table(spark, d, "indexed_rows"), "years", 0.1, 0.2)


@query(f"WITH {_CUTS} SELECT row_id, CASE WHEN {_YEAR} > test_year THEN 'test' WHEN {_YEAR} > val_year THEN 'val' ELSE 'train' END AS fold FROM indexed_rows, v")
def time_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_rows").select("row_id", "years")
    return folds.time_split(rows, "years", folds.year_cutoffs(rows, "years", 0.1, 0.2)).select("row_id", "fold")


@query("SELECT 0::BIGINT AS n_repeated, 0::BIGINT AS n_in_two_folds, 0::BIGINT AS n_missing, 0::BIGINT AS n_unknown")
def partition_check(spark: SparkSession, d: str) -> DataFrame:
    return folds.check_partition(time_split(spark, d), table(spark, d, "indexed_rows"), "row_id")


_FIRST = f"f AS (SELECT protein_ids AS p, min({_YEAR}) AS first, count(*) AS n FROM indexed_rows GROUP BY 1), cy AS (SELECT years AS y, (SELECT coalesce(sum(n), 0) FROM f WHERE first >= u.years) AS cold FROM (SELECT DISTINCT years FROM indexed_rows WHERE years >= 0) u), cut AS (SELECT coalesce(max(y) FILTER (cold >= 50), arg_max(y, cold)) AS cutoff FROM cy)"


@query(f"WITH {_FIRST} SELECT row_id, CASE WHEN first >= cutoff THEN 'val' ELSE 'train' END AS fold FROM indexed_rows JOIN f ON protein_ids = p, cut")
def time_protein_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_rows").select("row_id", "protein_ids", "years")
    return folds.time_protein_split(rows, "protein_ids", "years", 1, 50).select("row_id", "fold")


THREE = {"train": 0.7, "val": 0.1, "test": 0.2}


@query()
def cold_protein_split(spark: SparkSession, d: str) -> DataFrame:
    return folds.cold_split(table(spark, d, "indexed_rows").select("row_id", "protein_ids"), "protein_ids", THREE).select("row_id", "fold")


@query()
def scaffold_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_rows").select("row_id", F.when(F.col("scaffold_groups") >= 0, F.col("scaffold_groups").cast("string")).otherwise(F.concat(F.lit("row "), F.col("row_id"))).alias("scaffold"))
    return folds.cold_split(rows, "scaffold", THREE).select("row_id", "fold")


@query()
def double_cold_split(spark: SparkSession, d: str) -> DataFrame:
    return folds.double_cold_split(table(spark, d, "indexed_rows").select("row_id", "protein_ids", "scaffold_groups"), "row_id", "protein_ids", "scaffold_groups", THREE).select("row_id", "fold")


@query()
def nested_split(spark: SparkSession, d: str) -> DataFrame:
    """Test by year, validation by proteins first seen late."""
    rows = table(spark, d, "indexed_rows").select("row_id", "protein_ids", "scaffold_groups", "years")
    return folds.nested_split(rows, "time", "time-protein", 0.1, 0.2, "row_id", "protein_ids", "scaffold_groups", "years").select("row_id", "fold")


@query(f"WITH {_FIRST}, s AS (SELECT CASE WHEN first >= cutoff THEN 'val' ELSE 'train' END AS fold FROM indexed_rows JOIN f ON protein_ids = p, cut) SELECT count(*) AS n, count(*) FILTER (fold = 'val') AS n_val, (count(*) FILTER (fold = 'train') > 0 AND count(*) FILTER (fold = 'val') >= greatest(1, floor(count(*) * (0.25 * 0.05))) AND count(*) FILTER (fold = 'train') >= count(*) FILTER (fold = 'val')) AS usable FROM s")
def early_stop_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Whether proteins first seen late will do as a holdout."""
    return folds.usable_holdout(time_protein_split(spark, d), 0.05)


_COUNTS = "c AS (SELECT protein_ids, CAST(sum(activity_labels) AS BIGINT) AS n_pos, CAST(sum(1 - activity_labels) AS BIGINT) AS n_neg FROM indexed_rows GROUP BY 1)"
_RANKED = "k AS (SELECT row_id, protein_ids, activity_labels, row_number() OVER (PARTITION BY protein_ids, activity_labels ORDER BY md5(row_id || '|42'), row_id) AS r FROM indexed_rows)"
_PI = 0.4
_L = f"n_pos::DOUBLE / (n_pos + n_neg)"
_POS, _NEG = f"CAST(round_even(n_neg * {_PI}::DOUBLE / (1.0::DOUBLE - {_PI}), 0) AS BIGINT)", f"CAST(round_even(n_pos * (1.0::DOUBLE - {_PI}) / {_PI}, 0) AS BIGINT)"
_DOWN = f"g AS (SELECT *, CASE WHEN abs({_L} - {_PI}) < 1e-12 OR {_L} <= {_PI} THEN n_pos ELSE greatest(1, least(n_pos, {_POS})) END AS keep_pos, CASE WHEN abs({_L} - {_PI}) < 1e-12 OR {_L} > {_PI} THEN n_neg ELSE greatest(1, least(n_neg, {_NEG})) END AS keep_neg FROM c WHERE n_pos > 0 AND n_neg > 0)"
_UP = f"g AS (SELECT *, CASE WHEN abs({_L} - {_PI}) < 1e-12 OR {_L} > {_PI} THEN n_pos ELSE greatest(n_pos, {_POS}) END AS keep_pos, CASE WHEN abs({_L} - {_PI}) < 1e-12 OR {_L} <= {_PI} THEN n_neg ELSE greatest(n_neg, {_NEG}) END AS keep_neg FROM c WHERE n_pos > 0 AND n_neg > 0)"
_KEEP, _HAVE = "(CASE WHEN activity_labels = 1 THEN keep_pos ELSE keep_neg END)", "(CASE WHEN activity_labels = 1 THEN n_pos ELSE n_neg END)"
BALANCE = ("protein_ids", "activity_labels", "row_id")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_rows").select("row_id", "protein_ids", "activity_labels")


@query(f"WITH {_COUNTS}, {_DOWN} SELECT * FROM g")
def balance_counts(spark: SparkSession, d: str) -> DataFrame:
    return balance.goal_counts(balance.class_counts(_rows(spark, d), "protein_ids", "activity_labels"), _PI, upsample=False)


@query(f"WITH {_COUNTS} SELECT row_id, r.protein_ids, activity_labels, round(CASE WHEN activity_labels = 1 THEN ({_PI}::DOUBLE / (1.0 - {_PI})) * n_neg / n_pos ELSE 1 END, 6) AS weight FROM indexed_rows r JOIN c ON r.protein_ids = c.protein_ids WHERE n_pos > 0 AND n_neg > 0")
def balance_weights(spark: SparkSession, d: str) -> DataFrame:
    return _round(balance.class_weights(_rows(spark, d), *BALANCE, _PI), ["weight"])


@query(f"WITH {_COUNTS}, {_DOWN}, {_RANKED} SELECT row_id, k.protein_ids, activity_labels, 1 AS copy FROM k JOIN g ON k.protein_ids = g.protein_ids WHERE r <= {_KEEP}")
def downsample_rows(spark: SparkSession, d: str) -> DataFrame:
    return balance.resample(_rows(spark, d), *BALANCE, _PI)


@query(f"WITH {_COUNTS}, {_UP}, {_RANKED}, n AS (SELECT row_id, k.protein_ids, activity_labels, floor(({_KEEP} - r)::DOUBLE / {_HAVE}) + 1 AS copies FROM k JOIN g ON k.protein_ids = g.protein_ids) SELECT row_id, protein_ids, activity_labels, CAST(unnest(range(1, CAST(copies AS BIGINT) + 1)) AS INTEGER) AS copy FROM n WHERE copies > 0")
def upsample_rows(spark: SparkSession, d: str) -> DataFrame:
    return balance.resample(_rows(spark, d), *BALANCE, _PI, upsample=True)


@query(f"WITH {_COUNTS}, {_DOWN} SELECT count(*) AS n_targets_total, count(*) FILTER (n_pos > 0 AND n_neg > 0) AS n_targets_kept, count(*) FILTER (n_neg = 0) AS n_targets_all_active, count(*) FILTER (n_pos = 0) AS n_targets_all_inactive, CAST(sum(n_pos + n_neg) AS BIGINT) AS n_rows_before, (SELECT CAST(sum(keep_pos + keep_neg) AS BIGINT) FROM g) AS n_rows_after FROM c")
def balance_summary(spark: SparkSession, d: str) -> DataFrame:
    return balance.balance_summary(_rows(spark, d), "protein_ids", "activity_labels", _PI)


@query("SELECT row_id, r.protein_ids, round(pow(n, -0.5), 6) AS weight FROM indexed_rows r JOIN (SELECT protein_ids, count(*)::DOUBLE AS n FROM indexed_rows GROUP BY 1) c ON r.protein_ids = c.protein_ids")
def size_exponent(spark: SparkSession, d: str) -> DataFrame:
    return _round(balance.size_weights(_rows(spark, d), "protein_ids", "row_id", 0.5), ["weight"])


@query("SELECT row_id, protein_ids FROM (SELECT row_id, protein_ids, row_number() OVER (PARTITION BY protein_ids ORDER BY md5(row_id || '|42'), row_id) AS r FROM indexed_rows) WHERE r <= 20")
def cap_rows(spark: SparkSession, d: str) -> DataFrame:
    return balance.cap_rows(_rows(spark, d).select("row_id", "protein_ids"), "protein_ids", "row_id", 20)


@query(
    f"""WITH {_COUNTS}, t AS (SELECT *, {_L} AS prev, least(greatest(2, CAST(round_even((n_pos + n_neg) * 0.5::DOUBLE, 0) AS BIGINT)), n_pos + n_neg) AS total FROM c), u AS (SELECT *, least(greatest(1, CAST(round_even(total * prev, 0) AS BIGINT)), n_pos) AS p0 FROM t), v AS (SELECT *, least(total - p0, n_neg) AS q FROM u),
    w AS (SELECT protein_ids, CASE WHEN n_pos > 0 AND n_neg > 0 AND prev > 0.6 THEN CASE WHEN p0 + q < total THEN least(n_pos, total - q) ELSE p0 END ELSE n_pos END AS keep_pos, CASE WHEN n_pos > 0 AND n_neg > 0 AND prev > 0.6 THEN q ELSE n_neg END AS keep_neg FROM v), {_RANKED}
    SELECT row_id, k.protein_ids, activity_labels FROM k JOIN w ON k.protein_ids = w.protein_ids WHERE r <= {_KEEP}"""
)
def thin_prevalent(spark: SparkSession, d: str) -> DataFrame:
    return balance.thin_prevalent(_rows(spark, d), *BALANCE, 0.6, 0.5).select("row_id", "protein_ids", "activity_labels")


@query(
    """WITH l AS (SELECT row_id, t AS label, CASE WHEN assay_idx = t THEN 1 ELSE 0 END AS y FROM indexed_rows, range(0, 5) AS x(t)), c AS (SELECT label, sum(y) AS p, sum(1 - y) AS q FROM l GROUP BY 1),
    g AS (SELECT label, CASE WHEN p = 0 THEN 0 WHEN p::DOUBLE / (p + q) >= 0.3 THEN q ELSE greatest(0, least(q, CAST(round_even(p * ((1.0::DOUBLE - 0.3) / 0.3), 0) AS BIGINT))) END AS keep FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY label, y ORDER BY md5(row_id || '|42'), row_id) AS r FROM l)
    SELECT row_id, k.label, y FROM k JOIN g ON k.label = g.label WHERE y = 1 OR r <= keep"""
)
def negative_mask(spark: SparkSession, d: str) -> DataFrame:
    return balance.negative_mask(_label_cells(spark, d).select("row_id", "label", "y"), "label", "y", "row_id", 0.3)


@query(
    f"""WITH {_COUNTS}, e AS (SELECT protein_ids, n_pos, n_neg, row_number() OVER (ORDER BY md5('t|' || protein_ids || '|42'), protein_ids) - 1 AS pos FROM c WHERE n_pos > 0 AND n_neg > 0), n AS (SELECT count(*) AS total FROM e), pl AS (SELECT protein_ids, n_pos, n_neg, pos + i * total AS place FROM e, n, range(0, 9) AS t(i) WHERE pos + i * total < total + ((-total % 8) + 8) % 8), {_RANKED}
    SELECT CAST(place // 8 AS INTEGER) AS batch, CAST((place % 8) * 8 + CASE WHEN activity_labels = 1 THEN 0 ELSE 4 END + i AS INTEGER) AS slot, k.protein_ids, activity_labels, row_id FROM k JOIN pl ON k.protein_ids = pl.protein_ids, range(0, 4) AS t(i) WHERE i % {_HAVE} = r - 1"""
)
def stratified_batches(spark: SparkSession, d: str) -> DataFrame:
    return balance.batch_plan(_rows(spark, d), *BALANCE, 8, 4)


@query("WITH p AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM indexed_rows), n AS (SELECT count(*) AS n FROM p) SELECT CAST(s AS INTEGER) AS shard, row_id FROM p, n, range(0, 3) AS t(s) WHERE (((pos - s * 5000) % n) + n) % n < 5000")
def row_shards(spark: SparkSession, d: str) -> DataFrame:
    """Three runs of five thousand rows, each going on where the last ended."""
    return balance.row_shards(_rows(spark, d), "row_id", 5000, 3)


@query("SELECT CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS dev FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1")
def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round(features.column_stats(table(spark, d, "embeddings"), "embedding"), ["mean", "dev"])


@query(f"WITH h AS ({_HEADS}), x AS (SELECT head, b, greatest(1, (SELECT count(*) FROM h WHERE h.head = u.head AND h.t = b)) AS n FROM (SELECT DISTINCT head FROM h) u, range(0, 5) AS r(b)) SELECT head, CAST(b AS INTEGER) AS t, n, round(sum(n) OVER (PARTITION BY head)::DOUBLE / (5 * n), 6) AS weight FROM x")
def bin_weights(spark: SparkSession, d: str) -> DataFrame:
    return _round(features.bin_weights(_heads(spark, d), "head", "t", 5), ["weight"])


@query("SELECT label, round(CASE WHEN sum(y) > 0 THEN sum(1 - y)::DOUBLE / sum(y) ELSE 1 END, 6) AS pos_weight FROM (SELECT t AS label, CASE WHEN assay_idx = t THEN 1 ELSE 0 END AS y FROM indexed_rows, range(0, 5) AS x(t)) GROUP BY 1")
def pos_weights(spark: SparkSession, d: str) -> DataFrame:
    return _label_cells(spark, d).groupBy("label").agg(F.round(F.coalesce(F.try_divide(F.sum(1 - F.col("y")), F.sum("y")), F.lit(1.0)), 6).alias("pos_weight"))


@query(
    """SELECT row_id, CAST(len(x) AS INTEGER) AS width, round(list_sum(list_transform(x, lambda v: v::DOUBLE)), 4) AS total FROM (SELECT row_id, list_concat(p.embedding, l.embedding, list_transform(range(0, 5), lambda i: CASE WHEN i = assay_idx THEN 1.0::FLOAT ELSE 0.0::FLOAT END), [ph, temp]) AS x
    FROM indexed_rows r JOIN embeddings p ON p.vec_id = r.protein_ids JOIN embeddings l ON l.vec_id = r.ligand_ids)"""
)
def gather_features(spark: SparkSession, d: str) -> DataFrame:
    """Protein and ligand vectors, assay one-hot, pH and temperature side by side."""
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").alias("vec"))
    rows = table(spark, d, "indexed_rows").select("row_id", "protein_ids", "ligand_ids", "assay_idx", "ph", "temp")
    extras = [(F.col("assay_idx") == i).cast("float") for i in range(5)] + [F.col("ph"), F.col("temp")]
    got = features.gather(rows, vec, vec, "protein_ids", "ligand_ids", extras)
    return got.select("row_id", F.size("x").alias("width"), F.round(F.aggregate(F.transform("x", lambda v: v.cast("double")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_W = [(((i * 37) % 19) - 9) / 10 for i in range(64)]
_DOT = "list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((((i - 1) * 37) % 19) - 9) / 10.0::DOUBLE)) + 0.25"


@query(f"SELECT CAST(row_number() OVER (ORDER BY p DESC, vec_id) AS INTEGER) AS rank, vec_id, round(p, 6) AS p FROM (SELECT vec_id, round(1 / (1 + exp(-({_DOT}))), 9) AS p FROM embeddings) ORDER BY p DESC, vec_id LIMIT 25")
def score_topk(spark: SparkSession, d: str) -> DataFrame:
    """A screen: every vector scored by a linear model, the best 25 kept with their rank."""
    scored = table(spark, d, "embeddings").select("vec_id", F.round(features.linear_score(F.col("embedding"), _W, 0.25), 9).alias("p"))
    return features.top_rows(scored, "p", "vec_id", 25).select("rank", "vec_id", F.round("p", 6).alias("p"))


@query("SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(i AS INTEGER) AS label_idx, round(p, 6) AS p FROM (SELECT vec_id, p, i, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rank FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)) WHERE rank <= 3")
def topk_labels(spark: SparkSession, d: str) -> DataFrame:
    probs = table(spark, d, "embeddings").withColumn("p", F.transform("embedding", lambda v: v.cast("double")))
    return _round(features.top_labels(probs, "vec_id", "p", 3), ["p"])


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:5], lambda v: v::DOUBLE) AS l FROM embeddings), s AS (SELECT vec_id, list_transform(l, lambda v: exp(v - list_max(l))) AS x FROM e), q AS (SELECT vec_id, list_transform(x, lambda v: v / list_sum(x)) AS p FROM s)
    SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS guess, round(list_max(p), 6) AS p_max, round(list_sum(list_transform(range(1, 6), lambda i: p[i] * (i - 1))), 6) AS expected FROM q"""
)
def softmax_bins(spark: SparkSession, d: str) -> DataFrame:
    """Likeliest and expected bin of five logits."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double")).alias("l"))
    p = e.select("vec_id", S.softmax(F.col("l")).alias("p"))
    mean = F.aggregate(F.transform("p", lambda v, i: v * i), F.lit(0.0), lambda s, x: s + x)
    return p.select("vec_id", S.arg_max(F.col("p")).alias("guess"), F.round(F.array_max("p"), 6).alias("p_max"), F.round(mean, 6).alias("expected"))


_LOGITS = "SELECT protein_ids, activity_labels AS y, (((row_id * 7919 + activity_labels * 20) % 101) - 50) / 10.0::DOUBLE AS x FROM indexed_rows"


@query(
    f"""WITH l AS ({_LOGITS}), d AS (SELECT protein_ids, y, x, count(*) AS c FROM l GROUP BY ALL), b AS (SELECT protein_ids, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) AS bce, max(x) AS m FROM l GROUP BY 1 HAVING sum(y) > 0 AND sum(1 - y) > 0),
    r AS (SELECT p.protein_ids, sum(p.c * q.c * (greatest(q.x - p.x, 0) + ln(1 + exp(-abs(p.x - q.x))))) / sum(p.c * q.c) AS ranknet FROM d p JOIN d q ON p.protein_ids = q.protein_ids AND p.y = 1 AND q.y = 0 GROUP BY 1),
    w AS (SELECT d.protein_ids, any_value(m) + ln(sum(c * exp(x - m))) - sum(CASE WHEN y = 1 THEN c * x ELSE 0 END) / sum(CASE WHEN y = 1 THEN c ELSE 0 END) AS listwise FROM d JOIN b ON d.protein_ids = b.protein_ids GROUP BY 1)
    SELECT b.protein_ids, n_pos, n_neg, round(bce, 6) AS bce, round(ranknet, 6) AS ranknet, round(listwise, 6) AS listwise FROM b JOIN r ON b.protein_ids = r.protein_ids JOIN w ON b.protein_ids = w.protein_ids"""
)
def rank_losses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "indexed_rows").select("protein_ids", F.col("activity_labels").alias("y"), (((F.col("row_id") * 7919 + F.col("activity_labels") * 20) % 101 - 50) / F.lit(10.0)).alias("x"))
    got = metrics.rank_losses(rows, "protein_ids", "y", "x")
    return _round(got.withColumns({c: F.col(c).cast("bigint") for c in ("n_pos", "n_neg")}), ["bce", "ranknet", "listwise"])


@query(
    """WITH """ + ", ".join(f"m{i} AS (SELECT {i} AS candidate, avg(auroc) AS s FROM (" + _metrics_sql(_SCORED.replace("7919", str(k)), "protein_ids") + " SELECT auroc FROM m WHERE n_pos > 0 AND n_neg > 0))" for i, k in enumerate((7919, 6133, 4801))) + " SELECT arg_max(candidate, s) AS candidate, round(max(s), 6) AS score FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2)"
)
def grid_select(spark: SparkSession, d: str) -> DataFrame:
    """The candidate scores with the best macro AUROC, first on a tie."""
    rows = table(spark, d, "indexed_rows").withColumn("y", F.col("activity_labels"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), ((F.col("row_id") * k + F.col("y") * 20) % 101 / F.lit(100.0)).alias("s")) for i, k in enumerate((7919, 6133, 4801))]))
    long = rows.select("protein_ids", "y", each.alias("_e")).select("protein_ids", "y", "_e.*")
    per = metrics.binary_metrics(long, ["candidate", "protein_ids"], "y", "s")
    scores = metrics.macro(per, ["candidate"]).withColumn("none", F.lit(0.5))
    return _round(features.best_candidate(scores, "candidate", "macro_auroc", "none", "candidate"), ["score"])


@query(
    f"""WITH l AS ({_LONG.replace("target_name, activity_label", "activity_label")}), r AS (SELECT pair_id, assay_type, nm, {_LABEL} AS label FROM l WHERE nm IS NOT NULL)
    SELECT pair_id, CASE assay_type WHEN 'IC50' THEN 0 ELSE 1 END AS head_idx, {_BIN} AS y_bin, 1.0::DOUBLE AS loss_weight, false AS from_binary FROM r WHERE label IS NULL AND assay_type IN ('IC50', 'EC50')
    UNION ALL SELECT pair_id, h, 4, 0.5::DOUBLE, true FROM r, range(0, 2) AS t(h) WHERE label = 0 AND (assay_type = 'Other' OR (assay_type = 'IC50' AND h = 0) OR (assay_type = 'EC50' AND h = 1))"""
)
def range_rows(spark: SparkSession, d: str) -> DataFrame:
    long = prepare.unpivot_assays(table(spark, d, "prepared_pairs").withColumn("activity_label", S.activity_label(F.col("activity_label"))), ["pair_id", "activity_label"])
    return prepare.range_rows(long, "pair_id", weak=True, weak_weight=0.5).withColumn("head_idx", F.col("head_idx").cast("bigint"))


@query(f"SELECT pair_id, {', '.join(f'CASE WHEN assay_type = {chr(39)}{a}{chr(39)} THEN nm END AS {c}' for a, c in prepare.WIDE.items())} FROM (SELECT pair_id, assay_type, CASE WHEN nm = 0 THEN nm ELSE round_even(nm * pow(10.0, 5 - floor(log10(nm))), 0) / pow(10.0, 5 - floor(log10(nm))) END AS nm FROM ({_LONG}) WHERE nm IS NOT NULL)")
def wide_again(spark: SparkSession, d: str) -> DataFrame:
    """Each measurement back in its own column, to six significant digits."""
    return prepare.repivot(prepare.unpivot_assays(table(spark, d, "prepared_pairs"), ["pair_id"]), ["pair_id"], "assay_type", "nm")


@query("SELECT s_suppkey, n_name, coalesce(r_name, '') AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey")
def left_default(spark: SparkSession, d: str) -> DataFrame:
    """Inner join on one dimension, outer on another with an empty default."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    r = table(spark, d, "region").where("r_regionkey > 1")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("s_suppkey", "n_name", F.coalesce("r_name", F.lit("")).alias("region"))


@query("SELECT vec_id, round(1 / (1 + exp(-(" + _DOT + "))), 6) AS p FROM embeddings")
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """The linear model's scores, computed over arriving files."""
    from tessera.streaming.score import score_new_files

    def score(df: DataFrame) -> DataFrame:
        return df.select("vec_id", F.round(features.linear_score(F.col("embedding"), _W, 0.25), 6).alias("p"))

    return score_new_files(spark, f"{d}/embeddings.parque[t]", "vec_id bigint, embedding array<float>, label int", score)


@query()
def ligand_groups(spark: SparkSession, d: str) -> DataFrame:
    """Ligand key and scaffold of each prepared row."""
    from tessera.functions.ligands import ligand_key, over_distinct, scaffold_group

    rows = over_distinct(table(spark, d, "prepared_rows").select("row_id", "smiles"), "smiles", "ligand", ligand_key)
    return scaffold_group(rows, "smiles", "row_id").select("row_id", "ligand", "scaffold")


@query()
def fingerprint_bits(spark: SparkSession, d: str) -> DataFrame:
    """How many ligands set each position of the circular fingerprint."""
    from tessera.functions.ligands import circular_bits

    each = table(spark, d, "prepared_rows").where("smiles is not null").select("smiles").distinct().select(F.explode(circular_bits(F.col("smiles"))).alias("bit"))
    return each.groupBy("bit").agg(F.count("*").alias("n"))


@query()
def forest_scores(spark: SparkSession, d: str) -> DataFrame:
    """A forest fitted on nine tenths of the vectors, scoring the last tenth."""
    from tessera.operators import models

    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"), (F.col("label") % 2).alias("y"))
    model = models.fit(rows.where("vec_id % 10 > 0"), "forest", 64, numTrees=20, maxDepth=5)
    return models.score(model, rows.where("vec_id % 10 = 0")).select("vec_id", "y", F.round("p_active", 6).alias("p_active"))


@query("SELECT strategy, (SELECT count(*) FROM indexed_rows) AS n_rows, 0::BIGINT AS n_proteins_in_two, 0::BIGINT AS n_scaffolds_in_two FROM (VALUES ('protein'), ('double-cold')) t(strategy)")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the cold splits, and groups they leave in two folds: none."""
    rows = table(spark, d, "indexed_rows").select("row_id", "protein_ids", "scaffold_groups")
    out = []
    for how in ("protein", "double-cold"):
        s = cut(folds.split_pool(rows, how, THREE, "row_id", "protein_ids", "scaffold_groups", "years"), "folds")
        p = s.where("protein_ids is not null").groupBy("protein_ids").agg(F.countDistinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
        c = s.where("scaffold_groups >= 0").groupBy("scaffold_groups").agg(F.countDistinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
        checked = F.lit(0).cast("bigint") if how == "protein" else c
        out.append(s.agg(F.count("*").alias("n_rows")).select(F.lit(how).alias("strategy"), "n_rows", p.alias("n_proteins_in_two"), checked.alias("n_scaffolds_in_two")))
    return out[0].unionByName(out[1])


def _shares(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fold").agg(F.count("*").alias("n_rows"), F.count_distinct("block").alias("n_units"))


@query(greedy_sql("SELECT count(*) AS n FROM indexed_rows WHERE protein_ids IS NOT NULL GROUP BY protein_ids", THREE))
def cold_protein_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and proteins of each fold of the cold-protein split."""
    rows = table(spark, d, "indexed_rows").where("protein_ids is not null").select("row_id", F.col("protein_ids").alias("block"))
    return _shares(folds.cold_split(rows, "block", THREE))


@query(greedy_sql("SELECT count(*) AS n FROM indexed_rows GROUP BY CASE WHEN scaffold_groups >= 0 THEN 's' || scaffold_groups ELSE 'r' || row_id END", THREE))
def scaffold_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows and scaffolds of each fold of the scaffold split; a row without scaffold stands alone."""
    block = F.when(F.col("scaffold_groups") >= 0, F.concat(F.lit("s"), F.col("scaffold_groups"))).otherwise(F.concat(F.lit("r"), F.col("row_id")))
    return _shares(folds.cold_split(table(spark, d, "indexed_rows").select("row_id", block.alias("block")), "block", THREE))


_PLAN = SQL["stratified_batches"]
_LOGIT = "(((row_id * 7919 + activity_labels * 20) % 101) - 50) / 10.0::DOUBLE"


@query(
    f"""WITH plan AS ({_PLAN}), s AS (SELECT batch, slot // 8 AS place, activity_labels AS y, {_LOGIT} AS x FROM plan), p AS (SELECT a.batch, a.place, avg(greatest(b.x - a.x, 0) + ln(1 + exp(-abs(b.x - a.x)))) AS r FROM s a JOIN s b ON a.batch = b.batch AND a.place = b.place AND a.y = 1 AND b.y = 0 GROUP BY ALL),
    t AS (SELECT batch, place, avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) AS bce, ln(sum(exp(x))) - avg(CASE WHEN y = 1 THEN x END) AS l FROM s GROUP BY ALL)
    SELECT t.batch, round(avg(bce), 6) AS bce, round(avg(r), 6) AS ranknet, round(avg(l), 6) AS listwise FROM t JOIN p ON t.batch = p.batch AND t.place = p.place GROUP BY t.batch"""
)
def batch_losses(spark: SparkSession, d: str) -> DataFrame:
    """The three losses of every batch of the stratified plan."""
    x = ((F.col("row_id") * 7919 + F.col("activity_labels") * 20) % 101 - 50) / 10.0
    return _round(losses.batch_losses(stratified_batches(spark, d).withColumn("x", x), "activity_labels", "x", 4), ["bce", "ranknet", "listwise"])


@query("SELECT 'equal' AS ratio, 0.5::DOUBLE AS share UNION ALL SELECT 'dataset', round(avg(CASE WHEN activity_labels > 0.5 THEN 1 ELSE 0 END), 9) FROM indexed_rows UNION ALL SELECT 'custom', 0.3::DOUBLE")
def goal_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each kind of balance ratio stands for."""
    rows = _rows(spark, d)
    return spark.createDataFrame([(n, round(v, 9)) for n, v in (balance.goal_share(rows, "activity_labels", r) for r in ("equal", " Dataset ", 0.3))], "ratio string, share double")


# A raw table as dumps have it, made from the wide one: flags, relations and values of a pair in lists.
_CELL = {"type_ki": "ki_nm", "type_kd": "kd_nm", "type_ic50": "ic50_nm", "type_ec50": "ec50_nm", "type_other": "other_nm"}


def _raw(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "prepared_pairs")
    cells = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), F.col(c).alias("v")) for f, c in _CELL.items()]), lambda x: F.coalesce(S.strip(x["v"]) != "", F.lit(False)))
    base = pairs.select("pair_id", S.text(F.col("activity_label")).alias("cls"), cells.alias("c"))
    join = lambda f: F.array_join(F.transform("c", f), ";")
    is_of = lambda f: lambda x: F.when(x["f"] == f, "1").otherwise("0")
    flags = [join(is_of(f)).alias(f) for f in _CELL]
    relation = join(lambda x: F.when(x["v"].rlike("[<>]"), ">").otherwise("=")).alias("relation")
    return base.select("pair_id", F.nullif("cls", F.lit("")).alias("activity_class"), *flags, relation, join(lambda x: F.translate(S.strip(x["v"]), ";", " ")).alias("pchembl_value"))


_ITEMS = " UNION ALL ".join(f"SELECT pair_id, nullif({_t('activity_label')}, '') AS activity_class, '{a}' AS assay, {i} AS o, {c} AS v FROM prepared_pairs WHERE {_t(c)} <> ''" for i, (a, c) in enumerate((build.TYPE_FLAGS[f], c) for f, c in _CELL.items()))
_FLAGGED = f"i AS ({_ITEMS}), n AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS many, row_number() OVER (PARTITION BY pair_id ORDER BY o) - 1 AS item, regexp_matches(v, '[<>]') AS bound FROM i), a AS (SELECT pair_id, activity_class, CASE WHEN many > 1 THEN item END AS item, assay, replace({_t('v')}, ';', ' ') AS pchembl_value FROM n WHERE many = 1 OR NOT bound)"


@query(f"WITH {_FLAGGED} SELECT pair_id, CAST(item AS INTEGER) AS item, assay, pchembl_value FROM a")
def flagged_activities(spark: SparkSession, d: str) -> DataFrame:
    """Activities of the raw table by type flag, lists exploded and held to an exact relation."""
    return build.activity_rows(_raw(spark, d), ["pair_id", "activity_class"]).select("pair_id", "item", "assay", "pchembl_value")


@query(f"WITH {_FLAGGED} SELECT pair_id, CAST(item AS INTEGER) AS item, CASE WHEN activity_class IS NULL THEN 'quantitative' ELSE 'class' END AS pass FROM a ORDER BY activity_class IS NOT NULL, pair_id, item NULLS FIRST LIMIT 4000")
def limited_passes(spark: SparkSession, d: str) -> DataFrame:
    """The first four thousand activities, those without class before those with one."""
    rows = build.activity_rows(_raw(spark, d), ["pair_id", "activity_class"])
    return build.passes(rows, "activity_class", ["pair_id", "item"], 4000).select("pair_id", "item", "pass")


@query(f"WITH {_FLAGGED} SELECT count(*) FILTER (activity_class IS NULL) AS n_quantitative, count(*) FILTER (activity_class IS NOT NULL) AS n_class FROM a")
def pass_counts(spark: SparkSession, d: str) -> DataFrame:
    return build.count_passes(build.activity_rows(_raw(spark, d), ["pair_id", "activity_class"]), "activity_class")


_SIDE = f"s AS (SELECT {_t('chain_sequence')} AS sequence, arg_max(target_id, record_id) AS target_id FROM proteins WHERE {_t('chain_sequence')} <> '' GROUP BY 1), q AS (SELECT {_t('target_chain_sequence')} AS sequence, coalesce({_t('target_name')}, '') AS name, pair_id FROM prepared_pairs WHERE {_t('target_chain_sequence')} <> '')"


def _sidecar(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "proteins").select("record_id", S.text(F.col("chain_sequence")).alias("sequence"), "target_id").where("sequence <> ''")
    return prepare.last_by(own, "sequence", "record_id", ["target_id"])


@query(f"WITH {_SIDE}, f AS (SELECT sequence, arg_min(name, pair_id) AS name FROM q GROUP BY 1) SELECT f.sequence, name, target_id FROM f LEFT JOIN s ON f.sequence = s.sequence")
def protein_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chains of the pairs with the name first seen and the protein table's target."""
    return build.protein_sidecar(table(spark, d, "prepared_pairs"), _sidecar(spark, d), "pair_id", "target_chain_sequence", "target_name")


@query(f"WITH {_SIDE} SELECT count(*) FILTER (s.sequence IS NOT NULL) AS n_found, count(*) FILTER (s.sequence IS NULL) AS n_missed FROM q LEFT JOIN s ON q.sequence = s.sequence")
def sidecar_misses(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs find their chain in the protein table."""
    pairs = table(spark, d, "prepared_pairs").select("pair_id", S.text(F.col("target_chain_sequence")).alias("sequence")).where("sequence <> ''")
    return build.join_sidecar(pairs, _sidecar(spark, d))[1]


@query(f"WITH m AS (SELECT parent_molecule_chembl_id AS id, min(row_id) AS r FROM gpcrdb_data WHERE {_t('parent_molecule_chembl_id')} <> '' GROUP BY 1 HAVING min(row_id) % 5 > 0) SELECT row_id, parent_molecule_chembl_id, 'C' || r AS smiles FROM gpcrdb_data JOIN m ON parent_molecule_chembl_id = id")
def molecule_join(spark: SparkSession, d: str) -> DataFrame:
    """Activities joined with a dimension of molecules of which a fifth have no structure."""
    data = table(spark, d, "gpcrdb_data").select("row_id", "parent_molecule_chembl_id")
    first = data.where(S.text(F.col("parent_molecule_chembl_id")) != "").groupBy("parent_molecule_chembl_id").agg(F.min("row_id").alias("r"))
    molecules = first.select("parent_molecule_chembl_id", F.when(F.col("r") % 5 > 0, F.concat(F.lit("C"), "r")).alias("smiles"))
    return build.with_molecules(data, molecules, "parent_molecule_chembl_id")


@query("SELECT row_id, md5(row_id || '|42|3') AS h, CAST((row_number() OVER (ORDER BY md5(row_id || '|42|3'), row_id) - 1) // 1000 AS BIGINT) AS batch FROM indexed_rows")
def epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    """Every row once in the order of the third epoch, in batches of a thousand."""
    got = balance.epoch_order(_rows(spark, d), "row_id", 1000, 3)
    return got.select("row_id", F.md5(F.concat_ws("|", "row_id", F.lit("42"), F.lit("3"))).alias("h"), "batch")


@query(
    f"""WITH l AS (SELECT pair_id, assay_type, assay_order, {_t('p.ligand_smiles')} AS smiles, {_t('p.target_chain_sequence')} AS sequence FROM ({_LONG}) l JOIN prepared_pairs p USING (pair_id) WHERE nm IS NOT NULL AND {_t('p.ligand_smiles')} <> '' AND {_t('p.target_chain_sequence')} <> ''),
    a AS (SELECT sequence, row_number() OVER (ORDER BY min(pair_id * 5 + assay_order)) - 1 AS protein_ids FROM l GROUP BY 1), b AS (SELECT smiles, row_number() OVER (ORDER BY min(pair_id * 5 + assay_order)) - 1 AS ligand_ids FROM l GROUP BY 1)
    SELECT pair_id * 5 + assay_order AS row_id, protein_ids, ligand_ids FROM l JOIN a ON l.sequence = a.sequence JOIN b ON l.smiles = b.smiles"""
)
def pair_index(spark: SparkSession, d: str) -> DataFrame:
    """The pair table with sequences and SMILES numbered as first seen."""
    from tessera.sources.snapshots import index_rows

    return index_rows(prepare.prepared_long(table(spark, d, "prepared_pairs")), scaffold=None)["rows"].select("row_id", "protein_ids", "ligand_ids")


@query("WITH h AS (SELECT CAST(row_id % 3 AS INTEGER) AS head, CASE WHEN row_id % 3 = 1 THEN NULL ELSE avg(activity_labels) OVER (PARTITION BY row_id % 3) END AS f FROM indexed_rows) SELECT round(avg(f), 6) AS mean_head_f1, count(*) FILTER (f IS NOT NULL) AS n_heads FROM (SELECT head, any_value(f) AS f FROM h GROUP BY 1)")
def head_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean over heads of a metric that one of three heads lacks."""
    per = table(spark, d, "indexed_rows").groupBy((F.col("row_id") % 3).cast("int").alias("head")).agg(F.avg("activity_labels").alias("f"))
    return _round(metrics.head_mean(per.withColumn("macro_f1", F.when(F.col("head") != 1, F.col("f")).otherwise(float("nan")))), ["mean_head_f1"])
