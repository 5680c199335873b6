"""Queries for the general training-data problems: parsing, filling, heavy keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import eager, impute, parse
from tessera.persist import cut
from tessera.tables import table

PH, TEMP = (0.0, 14.0), (-80.0, 100.0)
HEAVY_SHARE = 0.02
CELLS = ("ki_nm", "ic50_nm", "kd_nm", "ec50_nm", "other_nm")


def _rejects(spark: SparkSession, d: str) -> DataFrame:
    return parse.rejects(table(spark, d, "gpcrdb_lines"), table(spark, d, "gpcrdb_data"), table(spark, d, "prepared_pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _rejects(spark, d).select("source_table", "row_id", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid raw records with typed values."""
    got = parse.parse_lines(table(spark, d, "gpcrdb_lines")).where("reason is null")
    names = [F.nullif(parse.strip(F.col(f)), F.lit("")).alias(f) for f in parse.FIELDS if f != "standard_value"]
    return got.select(F.col("row_id").alias("line_id"), *names, F.col("value").alias("standard_value"))


def _plain(c: str) -> Column:
    """The text without outer blanks, null where nothing is left."""
    return F.nullif(parse.strip(F.col(c)), F.lit("")).alias(c)


def p2_loaded_data(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows of gpcrdb_data with typed values."""
    got = parse.parse_fields(table(spark, d, "gpcrdb_data")).where("reason is null")
    return got.select("row_id", *[_plain(f) for f in parse.FIELDS if f != "standard_value"], F.col("value").alias("standard_value"))


def p2_loaded_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows of prepared_pairs with typed values.

    A cell ``c_nm`` without a number above zero is null; a bound such as ``>100`` has its sign in ``c_relation``
    and its number in ``c_bound``. Junk, and conditions and labels out of range, load as null; the SMILES alone decides whether
    a row loads.
    """
    got = parse.parse_smiles(table(spark, d, "prepared_pairs")).where("reason is null")
    cells = []
    for c in CELLS:
        s, n = parse.strip(F.col(c)), c.removesuffix("_nm")
        sign = F.nullif(F.regexp_extract(s, r"^(<=|>=|<|>|=|~)", 1), F.lit(""))
        bound = parse.number_or_null(F.substr(s, F.length(sign) + 1))
        cells += [parse.number_or_null(F.col(c)).alias(c), F.when(bound.isNotNull(), sign).alias(f"{n}_relation"), bound.alias(f"{n}_bound")]
    ph = S.ph(F.regexp_replace(parse.strip(F.col("ph")), r"^(?i:ph)\s*", "")).alias("ph")
    return got.select(F.col("row_id").alias("pair_id"), F.col("smiles").alias("ligand_smiles"), _plain("target_name"), _plain("target_organism"), *cells, S.activity_label(F.col("activity_label")).alias("activity_label"), ph, S.temperature(F.col("temp_c")).alias("temp_c"), _plain("target_chain_sequence"), "year", "loaded_at")


def p2_edits(spark: SparkSession, d: str) -> DataFrame:
    """Failing records of the three tables with the cheapest edits that mend them, which state the reason."""
    return _rejects(spark, d)


def filled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prepared_rows")
    cells = {"ph": impute.valid_between(F.col("ph"), *PH), "temp": impute.valid_between(F.col("temp"), *TEMP)}
    return impute.propagate_numeric(rows, "row_id", cells, near="assay_id", far="year", like="assay_type")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return impute.fills(filled(spark, d), "row_id", ["ph", "temp"], {"assay_id": "assay"})


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its observed or filled values, filled cells marked."""
    return filled(spark, d).withColumns({c: F.round(c, 6) for c in ("ph", "temp")})


def p3_organisms(spark: SparkSession, d: str) -> DataFrame:
    """Proteins without organism, with the likeliest one of their target name, else of their classification."""
    name = lambda c: eager.norm_name(F.col(c))
    got = impute.propagate_category(table(spark, d, "proteins"), "record_id", name("organism"), "organism", name("tid"), name("classification"), F.upper(F.substring("accession", 1, 1)))
    return got.where("organism_from is not null")


def _row_states(spark: SparkSession, d: str) -> DataFrame:
    return eager.key_states(table(spark, d, "indexed_rows"), {"protein_ids": F.col("protein_ids")}, {"active": F.col("activity_labels"), "ph": F.col("ph"), "temp": F.col("temp")})


def _pair_states(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "prepared_pairs")
    nm = [parse.number_or_null(F.col(c)) for c in ("ki_nm", "ic50_nm", "kd_nm", "ec50_nm", "other_nm")]
    return eager.key_states(pairs, {"target_name": eager.norm_name(F.col("target_name"))}, {"activity": F.coalesce(*[9 - F.log10(x) for x in nm])})


def _cell_states(spark: SparkSession, d: str, keyless: bool = False) -> DataFrame:
    """States per target name and cell of prepared_pairs; the pairs are counted with the first cell only."""
    sums = {c: 9 - F.log10(parse.number_or_null(F.col(c))) for c in CELLS}
    states = eager.key_states(table(spark, d, "prepared_pairs"), {"target_name": eager.norm_name(F.col("target_name"))}, sums, keyless)
    parts = ("count", "sum", "spread", "min", "max")
    cells = F.array(*[F.struct((F.col("rows") if c == CELLS[0] else F.lit(0).cast("bigint")).alias("rows"), *[F.col(f"{c}_{x}").alias(f"activity_{x}") for x in parts]) for c in CELLS])
    return states.select("target_name", F.explode(cells).alias("_c")).select("target_name", "_c.*")


def _reported(states: DataFrame, proteins: DataFrame, field: str) -> DataFrame:
    """``(field_name, key_value, rows, total, n_proteins, activity statistics)`` of all keys of one table, from both sides' states.

    ``states`` has ``key`` and a state of all rows without key; ``proteins`` is ``(key, n_proteins)``, one row each.
    """
    states = cut(states, "states")
    total = states.agg(F.sum("rows").alias("total"))
    joined = eager.join_states(states.where("key is not null"), proteins.where("key is not null").withColumn("rows", F.lit(1).cast("bigint")), "key", ["activity"], how="left")
    stats = eager.roll_up(joined, ["key", "n_proteins"], ["activity"])
    return stats.select(F.lit(field).alias("field_name"), F.col("key").cast("string").alias("key_value"), "rows", total.scalar().alias("total"), F.coalesce("n_proteins", F.lit(0)).alias("n_proteins"), *[f"activity_{x}" for x in ("count", "sum", "min", "max", "mean", "dev")])


def keys_report(spark: SparkSession, d: str) -> DataFrame:
    """Row counts and activity statistics of every protein of indexed_rows and every target name of prepared_pairs, with
    the number of protein records the key has: both tables pre-aggregated, joined as states with the pre-aggregated
    proteins, and rolled up. Written to the shared folder."""
    dim = lambda c: table(spark, d, "proteins").groupBy(c.alias("key")).agg(F.count("*").alias("n_proteins"))
    rows = eager.key_states(table(spark, d, "indexed_rows"), {"key": F.col("protein_ids")}, {"activity": F.col("activity_labels")}, keyless=True)
    cells = _cell_states(spark, d, keyless=True).withColumnRenamed("target_name", "key")
    a = _reported(rows, dim(F.col("protein_id")), "protein_ids")
    return cut(a.unionByName(_reported(cells, dim(eager.norm_name(F.col("tid"))), "target_name")), "keys")


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every key of both tables with its share of the rows and its activity statistics."""
    return _rounded(keys_report(spark, d)).withColumn("share", F.round(F.col("rows") / F.col("total"), 9)).drop("total")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the full report with more than HEAVY_SHARE of their table's rows."""
    return keys_report(spark, d).where(F.col("rows") > F.col("total") * F.lit(HEAVY_SHARE)).select("field_name", "key_value")


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: F.round(c, 6) for c in stats.columns if c.endswith(("_sum", "_mean", "_dev"))})


def p4_protein_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and activity statistics per protein."""
    return _rounded(eager.roll_up(_row_states(spark, d), ["protein_ids"], ["active", "ph", "temp"]))


def p4_target_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts per target name and statistics of one activity per pair, the first valid cell of Ki, IC50, Kd, EC50 and other."""
    return _rounded(eager.roll_up(_pair_states(spark, d), ["target_name"], ["activity"]))


def p4_target_measurements(spark: SparkSession, d: str) -> DataFrame:
    """Pairs per target name, and statistics of every valid measurement of them, a pair's second and further ones too."""
    return _rounded(eager.roll_up(_cell_states(spark, d), ["target_name"], ["activity"]))


def p4_joined_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of indexed_rows joined with proteins, by the proteins' target name, the join done on states."""
    names = table(spark, d, "proteins").select("protein_id", eager.norm_name(F.col("tid")).alias("target_name"))
    dim = names.groupBy(F.col("protein_id").alias("protein_ids"), "target_name").agg(F.count("*").alias("rows"))
    joined = eager.join_states(_row_states(spark, d).select("protein_ids", "rows", "active_count", "active_sum", "active_spread", "active_min", "active_max"), dim, "protein_ids", ["active"])
    return _rounded(eager.roll_up(joined, ["target_name"], ["active"]))


QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p2_loaded_data, p2_loaded_pairs, p2_edits, p3_found, p3_filled, p3_organisms, p4_found, p4_keys, p4_protein_stats, p4_target_stats, p4_target_measurements, p4_joined_stats)}

_VALID = {"ph": "CASE WHEN NOT isnan(ph) AND ph BETWEEN 0 AND 14 THEN ph END", "temp": "CASE WHEN NOT isnan(temp) AND temp BETWEEN -80 AND 100 THEN temp END"}


def _fill_sql(f: str) -> str:
    v = _VALID[f]
    return f"""SELECT row_id, '{f}' AS field_name, CASE WHEN a > 0 THEN 'assay' WHEN year IS NOT NULL AND y > 0 THEN 'year' ELSE 'none' END AS fill_from
    FROM (SELECT row_id, year, {v} AS v, CASE WHEN assay_id IS NOT NULL THEN count({v}) OVER (PARTITION BY assay_id) END AS a, count({v}) OVER (PARTITION BY year) AS y FROM prepared_rows) WHERE v IS NULL"""


def _filled_sql(f: str) -> str:
    """The closed form of what propagation comes to rest at, cells within kinds within groups."""
    a, b, c = impute.WEIGHTS
    fa, fc = impute.FAR_WEIGHTS
    v = _VALID[f]
    return f"""c{f} AS (SELECT assay_id, assay_type, year, coalesce(sum({v}), 0) AS s, count({v})::DOUBLE AS o, count(*) - count({v}) AS m, count(*)::DOUBLE AS n FROM prepared_rows GROUP BY ALL),
    u{f} AS (SELECT *, {a} * s / (n * (1 - {a} * m / n)) AS u, 1 / (1 - {a} * m / n) AS v FROM c{f} WHERE assay_id IS NOT NULL),
    k{f} AS (SELECT assay_id, assay_type, (sum(s) + sum(m * u)) / (sum(n) - {b} * sum(m * v)) AS b0, {c} * sum(m * v) / (sum(n) - {b} * sum(m * v)) AS b1, sum(s) AS s, sum(o) AS o, sum(n) AS n, sum(m * u) AS mu, sum(m * v) AS mv FROM u{f} GROUP BY ALL),
    g{f} AS (SELECT assay_id, (sum(s) + sum(mu + mv * {b} * b0)) / (sum(n) - sum(mv * ({b} * b1 + {c}))) AS g FROM k{f} GROUP BY ALL HAVING sum(o) > 0),
    x{f} AS (SELECT q.assay_id, q.assay_type, q.year, u + v * ({b} * (b0 + b1 * g) + {c} * g) AS x FROM u{f} q JOIN k{f} k ON q.assay_id = k.assay_id AND q.assay_type IS NOT DISTINCT FROM k.assay_type JOIN g{f} g ON g.assay_id = q.assay_id),
    y{f} AS (SELECT c.year, c.assay_type, sum(s) AS s, sum(o) AS o, sum(CASE WHEN x IS NULL THEN m ELSE 0 END) AS m FROM c{f} c LEFT JOIN x{f} x ON c.assay_id = x.assay_id AND c.assay_type IS NOT DISTINCT FROM x.assay_type AND c.year IS NOT DISTINCT FROM x.year WHERE c.year IS NOT NULL GROUP BY ALL),
    w{f} AS (SELECT *, o + m AS n, {fa} * s / ((o + m) * (1 - {fa} * m / (o + m))) AS u, 1 / (1 - {fa} * m / (o + m)) AS v FROM y{f} WHERE o + m > 0),
    h{f} AS (SELECT year, (sum(s) + sum(m * u)) / (sum(n) - {fc} * sum(m * v)) AS g FROM w{f} GROUP BY ALL HAVING sum(o) > 0),
    z{f} AS (SELECT w.year, w.assay_type, u + v * {fc} * g AS x FROM w{f} w JOIN h{f} h ON w.year = h.year)"""


def _filled_join(f: str) -> str:
    return f"LEFT JOIN x{f} ON r.assay_id = x{f}.assay_id AND r.assay_type IS NOT DISTINCT FROM x{f}.assay_type AND r.year IS NOT DISTINCT FROM x{f}.year LEFT JOIN z{f} ON r.year = z{f}.year AND r.assay_type IS NOT DISTINCT FROM z{f}.assay_type"


def _filled_cells(f: str) -> str:
    v = _VALID[f].replace(f"({f})", f"(r.{f})").replace(f"{f} BETWEEN", f"r.{f} BETWEEN").replace(f"THEN {f}", f"THEN r.{f}")
    return f"round(coalesce({v}, x{f}.x, z{f}.x), 6) AS {f}, CASE WHEN {v} IS NULL THEN CASE WHEN x{f}.x IS NOT NULL THEN 'assay_id' WHEN z{f}.x IS NOT NULL THEN 'year' ELSE 'none' END END AS {f}_from"


_NAME = "nullif(trim(regexp_replace(lower(target_name), '\\s+', ' ', 'g')), '')"
_NUMBER = "CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND try_cast(trim({c}) AS DOUBLE) > 0 AND isfinite(try_cast(trim({c}) AS DOUBLE)) THEN try_cast(trim({c}) AS DOUBLE) END"
_ACTIVITY = "coalesce(" + ", ".join(f"9 - log10({_NUMBER.format(c=c)})" for c in ("ki_nm", "ic50_nm", "kd_nm", "ec50_nm", "other_nm")) + ")"


def _stats_sql(name: str, expression: str) -> str:
    v = f"({expression})"
    return f"count({v}) AS {name}_count, round(sum({v}), 6) AS {name}_sum, min({v}) AS {name}_min, max({v}) AS {name}_max, round(avg({v}), 6) AS {name}_mean, round(stddev_pop({v}), 6) AS {name}_dev"


_MEASURED = " UNION ALL ".join(f"SELECT k, 9 - log10({_NUMBER.format(c=c)}) AS v FROM n WHERE k IS NOT NULL" for c in CELLS)

# One field, quoted or bare; BLANKS are those that parse.strip knows.
_CSV = '("[^"]*(?:""[^"]*)*"|[^",]*)'
_RAW = "^" + ",".join([_CSV] * 7) + "$"
_BLANKS = f"'{parse.BLANK}'"


def _loaded_sql(source: str, key: str, fields: list[str]) -> str:
    clean = [f"nullif(trim({f}, {_BLANKS}), '') AS {n}" for n, f in zip(parse.FIELDS, fields)]
    v = "standard_value"
    number = rf"regexp_full_match({v}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND try_cast({v} AS DOUBLE) > 0 AND isfinite(try_cast({v} AS DOUBLE))"
    return f"""SELECT {key}, {', '.join(parse.FIELDS[:-1])}, try_cast({v} AS DOUBLE) AS {v} FROM (SELECT {key}, {', '.join(clean)} FROM {source})
    WHERE (standard_relation IS NULL OR standard_relation IN ('=', '<', '>', '<=', '>=', '~')) AND ({v} IS NULL OR ({number}))"""


_BODY = r"regexp_replace(raw, E'(\r\n|\n|\r)$', '')"
_CUT = [f"regexp_extract(body, '{_RAW}', {i})" for i in range(1, 8)]
_BARE = [f"""CASE WHEN {c} LIKE '"%' THEN replace(substr({c}, 2, length({c}) - 2), '""', '"') ELSE {c} END""" for c in _CUT]

SQL: dict[str, str] = {
    "p2_loaded": _loaded_sql(f"(SELECT line_id, {_BODY} AS body FROM gpcrdb_lines) WHERE regexp_full_match(body, '{_RAW}')", "line_id", _BARE),
    "p2_loaded_data": _loaded_sql("gpcrdb_data", "row_id", parse.FIELDS),
    "p3_found": f"{_fill_sql('ph')} UNION ALL {_fill_sql('temp')}",
    "p3_filled": f"WITH {_filled_sql('ph')}, {_filled_sql('temp')} SELECT row_id, {_filled_cells('ph')}, {_filled_cells('temp')} FROM prepared_rows r {_filled_join('ph')} {_filled_join('temp')}",
    "p4_keys": f"""WITH a AS (SELECT protein_ids AS k, count(*) AS rows, {_stats_sql('activity', 'activity_labels::DOUBLE')} FROM indexed_rows WHERE protein_ids IS NOT NULL GROUP BY 1),
    n AS (SELECT {_NAME} AS k, * FROM prepared_pairs), b AS (SELECT k, count(*) AS rows FROM n WHERE k IS NOT NULL GROUP BY 1), m AS (SELECT k, {_stats_sql('activity', 'v')} FROM ({_MEASURED}) GROUP BY 1)
    SELECT 'protein_ids' AS field_name, CAST(k AS VARCHAR) AS key_value, rows, round(rows / (SELECT count(*) FROM indexed_rows), 9) AS share, (SELECT count(*) FROM proteins WHERE protein_id = k) AS n_proteins, a.* EXCLUDE (k, rows) FROM a
    UNION ALL SELECT 'target_name', b.k, rows, round(rows / (SELECT count(*) FROM prepared_pairs), 9), (SELECT count(*) FROM proteins WHERE {_NAME.replace('target_name', 'tid')} = b.k), coalesce(activity_count, 0), m.* EXCLUDE (k, activity_count) FROM b LEFT JOIN m ON b.k = m.k""",
    "p4_target_measurements": f"WITH n AS (SELECT {_NAME} AS k, * FROM prepared_pairs), b AS (SELECT k, count(*) AS rows FROM n WHERE k IS NOT NULL GROUP BY 1), m AS (SELECT k, {_stats_sql('activity', 'v')} FROM ({_MEASURED}) GROUP BY 1) SELECT b.k AS target_name, rows, coalesce(activity_count, 0) AS activity_count, m.* EXCLUDE (k, activity_count) FROM b LEFT JOIN m ON b.k = m.k",
    "p4_found": f"""SELECT 'protein_ids' AS field_name, CAST(protein_ids AS VARCHAR) AS key_value FROM indexed_rows WHERE protein_ids IS NOT NULL GROUP BY protein_ids HAVING count(*) > 0.02 * (SELECT count(*) FROM indexed_rows)
    UNION ALL SELECT 'target_name', k FROM (SELECT {_NAME} AS k FROM prepared_pairs) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 0.02 * (SELECT count(*) FROM prepared_pairs)""",
    "p4_protein_stats": f"SELECT protein_ids, count(*) AS rows, {_stats_sql('active', 'activity_labels::DOUBLE')}, {_stats_sql('ph', 'ph::DOUBLE')}, {_stats_sql('temp', 'temp::DOUBLE')} FROM indexed_rows WHERE protein_ids IS NOT NULL GROUP BY 1",
    "p4_target_stats": f"SELECT target_name, count(*) AS rows, {_stats_sql('activity', 'a')} FROM (SELECT {_NAME} AS target_name, {_ACTIVITY} AS a FROM prepared_pairs) WHERE target_name IS NOT NULL GROUP BY 1",
    "p4_joined_stats": f"SELECT target_name, count(*) AS rows, {_stats_sql('active', 'activity_labels::DOUBLE')} FROM (SELECT protein_id, {_NAME.replace('target_name', 'tid')} AS target_name FROM proteins) p JOIN indexed_rows r ON r.protein_ids = p.protein_id GROUP BY 1",
}
