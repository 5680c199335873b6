"""Rows that fail to parse: separated with the reason, the rest loaded with typed values.

Raw comma-separated records go through a minimum-cost error parse: a dynamic program over the
characters may insert or delete double quotes and delimiters. A record of cost zero is what its
grammar says; any other comes out with the cheapest edits that would make it one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessera.functions.smiles import is_molecule

# The fields of a record and the relations that are known.
FIELDS = "entry_name accession parent_molecule_chembl_id standard_relation standard_type standard_units standard_value".split()
RELATIONS = ["=", "<", ">", "<=", ">=", "~"]

#: A decimal number in digits 0-9 with optional sign, point and exponent.
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

#: White space as Python's str.strip knows it; Java's trim and \s know less.
BLANK = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without the white space at both ends; works through the text once, so any length will do."""
    return F.btrim(c, F.lit(BLANK))


def relation_fails(c: Column) -> Column:
    """True for a relation that isn't known; a null or blank one is missing, not failing."""
    s = strip(c)
    return F.coalesce((s != "") & ~s.isin(RELATIONS), F.lit(False))


def number_or_null(c: Column) -> Column:
    """The decimal number above zero that the text holds, else null."""
    s = strip(c)
    v = F.when(s.rlike(f"^{NUMBER}$"), s.try_cast("double"))
    return F.when((v > 0) & (v < float("inf")), v)


def value_fails(c: Column) -> Column:
    """True for a value that is no finite decimal number above zero; a null or blank one is missing."""
    s = strip(c)
    return F.coalesce((s != "") & number_or_null(c).isNull(), F.lit(False))


#: Costs of a reading, each kind above any number of the next: edits of quotes, edits of delimiters, and what speaks
#: against a reading without being an edit (a relation or value of the wrong type, fields glued or made empty).
QUOTE_COST, DELIMITER_COST, TYPE_COST = 1 << 40, 1 << 20, 1
_END = re.compile(r"(?:\r\n|\n|\r)\Z")
_PIECE = re.compile(r'[",]|[;|\t]|[^",;|\t]+')
_TAIL = re.compile(rf"[{BLANK}]*(?:,|\Z)")
_NUMBER = re.compile(NUMBER, re.ASCII)


def _value_ok(text: str) -> bool:
    s = text.strip(BLANK)
    return s == "" or (_NUMBER.fullmatch(s) is not None and 0 < float(s) < float("inf"))


def _relation_ok(text: str) -> bool:
    s = text.strip(BLANK)
    return s == "" or s in RELATIONS


#: The typed fields and what they take.
TYPES = {FIELDS.index("standard_relation"): _relation_ok, FIELDS.index("standard_value"): _value_ok}


def zero_cost(body: str) -> list[str] | None:
    """The fields of the reading without edits, which is unique, or None where there is none.

    This is the dynamic program below kept to states of cost zero: one state lives at a time.
    """
    out: list[str] = []
    held: list[str] = []
    state = 0
    for c in _PIECE.findall(body):
        if c == ",":
            if state == 2:
                held.append(c)
            else:
                out.append("".join(held))
                held.clear()
                state = 0
        elif c == '"':
            if state == 1:
                return None
            if state == 3:
                held.append(c)
            state = 3 if state == 2 else 2
        elif state == 3:
            return None
        else:
            held.append(c)
            state = state or 1
    if state == 2:
        return None
    out.append("".join(held))
    return out


# Moves on reading a comma, a quote or anything else: from state, to state, cost, deleted. A comma that ends a field moves to the
# next field's state 0, which is 4 further on.
_MOVES = {
    ",": [(0, 4, 0, 0), (1, 4, 0, 0), (3, 4, 0, 0), (2, 2, 0, 0), (0, 0, DELIMITER_COST, 1), (1, 1, DELIMITER_COST, 1), (3, 3, DELIMITER_COST, 1)],
    '"': [(0, 2, 0, 0), (2, 3, 0, 0), (3, 2, 0, 0), *[(a, a, QUOTE_COST, 1) for a in range(4)]],
    "x": [(0, 1, 0, 0), (1, 1, 0, 0), (2, 2, 0, 0)],
}


def min_cost_parse(text: str, fields: int = len(FIELDS)) -> list[str]:
    """The edits of the cheapest reading of ``text`` as ``fields`` comma-separated fields.

    States while reading: at a field's start (0), in a bare field (1), in a quoted field (2), after a
    closing quote (3); each with the number of the field. Edits: insert or delete a double quote, insert or
    delete a comma, which joins what it parted. The fewest quote edits win, then the fewest of delimiters, then
    the reading whose relation and value are of their types and that glues or empties the fewest fields. A line
    end after the last field is free. Runs without marks are one step; the way back takes two bytes per state and step.
    """
    body = _END.sub("", text, count=1)
    n, none = 4 * fields, 1 << 62
    cost = [none] * n
    cost[0] = 0
    read_rows: list[bytes] = []
    insert_rows: list[bytes] = []
    ends: list[int] = []

    def insert(cost: list[int], coming: str) -> None:
        # A delimiter between text and a quote would part what only an edit of the quote can mend.
        ways = [(0, DELIMITER_COST + TYPE_COST)] + [(1, DELIMITER_COST)] * (coming != '"') + [(3, DELIMITER_COST)] * (coming in ("", ","))
        back = bytearray(n)
        for s in range(0, n, 4):
            for a, b in ((s, s + 2), (s + 2, s + 3)):
                if cost[a] + QUOTE_COST < cost[b]:
                    cost[b] = cost[a] + QUOTE_COST
                    back[b] = a + 1
            if s + 4 < n:
                for a, price in ways:
                    if cost[s + a] + price < cost[s + 4]:
                        cost[s + 4] = cost[s + a] + price
                        back[s + 4] = s + a + 1
        insert_rows.append(bytes(back))

    insert(cost, body[:1])
    starts: list[int] = []
    for m in _PIECE.finditer(body):
        c = m[0]
        moves = _MOVES.get(c) or _MOVES["x"]
        # To join a field with what isn't blank speaks against a reading.
        glued = TYPE_COST if c == "," and _TAIL.match(body, m.end()) is None else 0
        wrong = {f: c != '"' and (c == "," or not ok(c)) for f, ok in TYPES.items()}
        new, back = [none] * n, bytearray(n)
        for s in range(0, n, 4):
            bad = wrong.get(s >> 2)
            for a, b, price, gone in moves:
                p = cost[s + a]
                if s + b < n and p < none:
                    if bad and b < 4 and not gone:
                        price += TYPE_COST
                    elif gone and a:
                        price += glued
                    if p + price < new[s + b]:
                        new[s + b] = p + price
                        back[s + b] = (s + a) * 2 + gone + 1
        insert(new, body[m.end() : m.end() + 1])
        cost = new
        read_rows.append(bytes(back))
        starts.append(m.start())
        ends.append(m.end())
    cost[n - 4] += TYPE_COST  # an empty last field
    here = min((n - 4, n - 3, n - 1), key=cost.__getitem__)
    edits: list[str] = []
    for i in range(len(read_rows), -1, -1):
        back = insert_rows[i]
        at = ends[i - 1] if i else 0
        while back[here]:
            a = back[here] - 1
            edits.append(f"insert {'delimiter' if here % 4 == 0 else 'quote'} at {at}")
            here = a
        if i:
            code = read_rows[i - 1][here] - 1
            if code & 1:
                edits.append(f"delete {'delimiter' if body[starts[i - 1]] == ',' else 'quote'} at {starts[i - 1]}")
            here = code >> 1
    return edits[::-1]


def read_record(text: str, fields: int = len(FIELDS)) -> tuple[str | None, list[str], list[str]]:
    """Reason, fields and edits of one raw record; the reason is read off the edits.

    No edit is reason None, with the fields. An edit of a quote is ``quoting``, else one of a delimiter is
    ``columns``; of records with neither, a relation or value of the wrong type is an edit ``replace
    standard_relation`` or ``replace standard_value`` and the reason ``relation`` or ``value``.
    """
    got = zero_cost(_END.sub("", text, count=1))
    if got is not None and len(got) == fields:
        edits = [f"replace {FIELDS[f]}" for f, ok in TYPES.items() if f < fields and not ok(got[f])]
        return reason_of(edits), got, edits
    edits = min_cost_parse(text, fields)
    return reason_of(edits), [], edits


def reason_of(edits: list[str]) -> str | None:
    """The first reason that a list of edits states."""
    for word, reason in (("quote", "quoting"), ("delimiter", "columns"), ("standard_relation", "relation"), ("standard_value", "value")):
        if any(e.split()[1] == word for e in edits):
            return reason
    return None


_LINES = "row_id bigint, reason string, cost bigint, edits array<string>, " + ", ".join(f"{f} string" for f in FIELDS)


def parse_lines(lines: DataFrame, key: str = "line_id", raw: str = "raw") -> DataFrame:
    """Read raw records: ``(row_id, reason, cost, edits, the seven fields, value)``.

    ``reason`` is null for rows that load, with ``value`` typed; else the first of ``quoting``,
    ``columns``, ``relation``, ``value`` that the ``edits`` of the cheapest reading state; ``cost`` is their
    number. A null record counts as an empty one (one field, so ``columns``). Other
    columns of the input are not carried; repeated records each give their own row; texts of any
    length are read whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_record(t or "") for t in b.column(1).to_pylist()]
            none = [None] * len(FIELDS)
            cols = list(zip(*[r[1] or none for r in rows])) if rows else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), *[pa.array(c, pa.string()) for c in cols]],
                names=["row_id", "reason", "cost", "edits", *FIELDS],
            )

    got = lines.select(F.col(key).cast("bigint"), F.col(raw)).mapInArrow(read, _LINES)
    return got.withColumn("value", F.when(F.col("reason").isNull(), number_or_null(F.col("standard_value"))))


def _typed(rows: DataFrame) -> DataFrame:
    bad = {"relation": relation_fails(F.col("standard_relation")), "value": value_fails(F.col("standard_value"))}
    edits = F.filter(F.array(*[F.when(c, f"replace standard_{n}") for n, c in bad.items()]), lambda e: e.isNotNull())
    out = rows.withColumn("edits", edits).withColumn("cost", F.size("edits").cast("bigint"))
    reason = F.substring_index(F.element_at("edits", 1), "_", -1)
    out = out.withColumn("reason", F.when(F.col("cost") > 0, reason))
    return out.withColumn("value", F.when(F.col("reason").isNull(), number_or_null(F.col("standard_value"))))

def parse_fields(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """The same for rows whose fields are apart already, where only a type can be wrong: all columns, ``reason``,
    ``cost``, ``edits`` and ``value``."""
    return _typed(rows)


@F.arrow_udf(BooleanType())
def _not_molecule(s: pa.Array) -> pa.Array:
    return pa.array([t is not None and not is_molecule(t) and t.strip() != "" for t in s.to_pylist()], pa.bool_())


def parse_smiles(rows: DataFrame, key: str = "pair_id", smiles: str = "ligand_smiles") -> DataFrame:
    """Key, SMILES without outer blanks, ``reason`` (``smiles`` where the text isn't one molecule), ``cost``, ``edits`` and all
    other columns.

    A null or blank text is missing, not failing, and loads as null.
    """
    s = strip(F.col(smiles))
    bad = _not_molecule(F.col(smiles))
    own = {"row_id", "smiles", "reason", "cost", "edits"}
    rest = [c for c in rows.columns if c not in own | {key, smiles}]
    got = rows.select(F.col(key).alias("row_id"), F.when(s != "", s).alias("smiles"), F.when(bad, "smiles").alias("reason"), *rest)
    reason = F.col("reason").isNotNull()
    return got.select("row_id", "smiles", "reason", F.when(reason, 1).otherwise(0).cast("bigint").alias("cost"), F.when(reason, F.array(F.lit(f"replace {smiles}"))).otherwise(F.array().cast("array<string>")).alias("edits"), *rest)


def parsed(lines: DataFrame, data: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The three tables read, each with ``row_id, reason, cost, edits`` and its typed columns."""
    return {"gpcrdb_lines": parse_lines(lines), "gpcrdb_data": parse_fields(data), "prepared_pairs": parse_smiles(pairs)}


def rejects(lines: DataFrame, data: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every failing record of the three tables: ``(source_table, row_id, reason, cost, edits)``, one row each, with the
    edits that state the reason."""
    out = [d.where("cost > 0").select(F.lit(n).alias("source_table"), F.col("row_id").cast("bigint").alias("row_id"), "reason", "cost", F.array_join("edits", "; ").alias("edits")) for n, d in parsed(lines, data, pairs).items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
