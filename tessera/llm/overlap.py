"""Same or nearly same records across splits, by a sparse suffix array over partitioned texts.

A record's text is its chain, under the key of its ligand. Of every text those suffixes are kept whose first
residues are the least of their window by a hash, so that two texts that share a long enough stretch keep the
same suffix of it. The suffixes of all texts are partitioned by ligand and prefix and sorted there in the
order of their residues; what has no neighbour under the same ligand with a common prefix drops out. Suffixes from
different splits that are left share a span, which fixes how their texts lie on each other. What lies so is compared
residue by residue, which gives all shared spans, and these are merged into the coverage of a record.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.smiles import ligand_keys, same_ligands
from tessera.persist import cut

#: At most so many residues may be missing or added at each end, and of 100 compared ones so many differ.
END, PERCENT = 25, 3


def least_run(n: int) -> int:
    """Residues in a row that are equal in any two alike texts of which ``n`` residues are compared."""
    differ = n * PERCENT // 100
    return -(-(n - differ) // (differ + 1))


#: Prefix length and window of the kept suffixes, and the lengths of the texts that keep such: texts that share
#: prefix + window - 1 residues in a row keep a common suffix. A pair is compared over its shorter text's length less
#: END at least, and ``least_run`` of that is shared: 25 from 100 residues on, 17 from 17 on. The pairs whose
#: shorter text is below the first bound are found by the next line, whose upper bound is 2 * END more; the last
#: keeps every suffix by its first residue, so no pair of texts of any length is lost.
SCALES = ((12, 14, 125, 1 << 40), (6, 12, 42, 125 + 2 * END), (1, 1, 1, 42 + 2 * END))
#: A prefix that more held-out texts of a ligand share is parted into so many of them each.
TOGETHER = 4096

_MULT = np.uint64(0x9E3779B97F4A7C15)


def chain(c):  # noqa: ANN001, ANN201
    """Without white space, ``-``, ``*`` and letter case."""
    plain = ~c.rlike("[^A-Za-z]")
    return F.upper(F.when(plain, c).otherwise(F.regexp_replace(c, r"[\s\-*\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", "")))


_LIGAND = ["k1", "k2", "k3"]


def keyed(rows: DataFrame, row: str = "row_id", split: str = "split_name", smiles: str = "smiles", sequence: str = "sequence") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(row, train, k1, k2, k3, smiles_id, chain_id)`` of rows in a known split with a ligand and a chain, ``(chain_id, chain)`` and
    ``(smiles_id, smiles, k1, k2)``, all written to the shared folder.

    Each distinct SMILES is read once and each distinct chain kept once, known by its 128-bit digest. Texts that aren't
    SMILES and empty chains match nothing.
    """
    side = F.lower(F.trim(F.col(split)))
    base = rows.where(side.isin("train", "val", "test")).select(F.col(row).cast("bigint").alias("row"), (side == "train").alias("train"), F.col(smiles).alias("smiles"), chain(F.col(sequence)).alias("chain"))
    # The digest is taken from a column of its own and nothing filters by the chain, so each chain is cleaned once.
    base = base.where("row is not null and smiles is not null").withColumn("chain_id", F.when(F.col("chain") != "", F.unhex(F.md5("chain"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), 4096):
                part = texts[lo : lo + 4096]
                ok = [(t, *k) for t, k in zip(part, ligand_keys(part)) if k is not None]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ok], pa.string()), pa.array([x[1] for x in ok], pa.int64()), pa.array([x[2] for x in ok], pa.int64())], names=["smiles", "k1", "k2"])

    # A number of partitions keeps adaptive execution from joining them; reading SMILES is work, not bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = base.select("smiles").distinct().repartition(parts, "smiles").mapInArrow(read, "smiles string, k1 bigint, k2 bigint")
    keys = cut(keys.withColumn("smiles_id", F.monotonically_increasing_id()), "keys")
    narrow = base.select("row", "train", "smiles", "chain_id").join(keys, "smiles").select("row", "train", "k1", "k2", F.lit(0).alias("k3"), "smiles_id", "chain_id")
    chains = cut(base.select("chain_id", "chain").dropDuplicates(["chain_id"]), "chains")
    return cut(narrow, "keyed").where("chain_id is not null"), chains.where("chain_id is not null"), keys


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, by doubling."""
    got, have = v, 1
    while have * 2 <= w:
        got = np.minimum(got[:-have], got[have:])
        have *= 2
    if have < w:
        got = np.minimum(got[: len(v) - w + 1], got[w - have :][: len(v) - w + 1])
    return got


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one behind the other as numbers of their residues, and their lengths."""
    whole = "".join(texts)
    flat = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    return flat, np.array([len(t) for t in texts], np.int64)


def kept_suffixes(text: np.ndarray, lengths: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and first ``k`` residues of the suffixes kept of texts that lie in one array.

    The residues are packed five bits each, so numbers are in the order of the letters; what is no letter
    shares the five codes behind them, which can add candidates but lose none.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    none = (np.array([], np.int64),) * 2 + (np.array([], np.uint64),)
    if len(text) < k + w - 1:
        return none
    small = np.where((text >= 65) & (text <= 90), text - 64, 27 + text % 5).astype(np.uint64)
    packed = np.zeros(len(text) - k + 1, np.uint64)
    for j in range(k):
        packed = (packed << np.uint64(5)) | small[j : len(text) - k + 1 + j]
    if w == 1:
        place = np.arange(len(packed))
    else:
        # Hash above and place below in one number, so the least of a window is one suffix.
        code = packed * _MULT
        code = (code ^ (code >> np.uint64(29))) * _MULT
        at = np.arange(len(code), dtype=np.uint64) & np.uint64(0xFFFFFF)
        least = _window_min((code & ~np.uint64(0xFFFFFF)) | at, w)
        owner = np.repeat(np.arange(len(starts)), lengths)
        first = np.flatnonzero(np.arange(len(least)) + k + w - 1 <= ends[owner[: len(least)]])
        pick = (first & ~0xFFFFFF) | (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        place = np.unique(np.where(pick < first, pick + 0x1000000, pick))
    which = np.searchsorted(ends, place, side="right")
    inside = place + k <= ends[which]
    which, place = which[inside], place[inside]
    return which, place - starts[which], packed[place]


def suffixes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and prefix of all suffixes kept of ``texts``, prefixes of other lengths in other ranges."""
    flat, lengths = _codes(texts)
    ends = np.cumsum(lengths)
    parts = []
    for n, (k, w, low, high) in enumerate(SCALES):
        of = np.flatnonzero((lengths >= low) & (lengths < high))
        if len(of):
            some = flat if len(of) == len(lengths) else np.concatenate([flat[ends[i] - lengths[i] : ends[i]] for i in of])
            which, place, code = kept_suffixes(some, lengths[of], k, w)
            parts.append((of[which], place, code | (np.uint64(n) << np.uint64(61))))
    if not parts:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)
    which, place, code = (np.concatenate(x) for x in zip(*parts))
    return which, place, code


#: Residues whose suffixes are computed at once.
_RESIDUES = 1 << 20
_SUFFIX = "k1 bigint, prefix bigint, class bigint, spot bigint"


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(k1, prefix, class, spot)`` of the kept suffixes of ``(k1, class, train, held, chain)``; a spot is the place times
    four, plus one if the text is in train and two if it is held out."""
    for b in batches:
        k1, cls = b.column(0).to_numpy(), b.column(1).to_numpy()
        side = b.column(2).to_numpy(zero_copy_only=False) + 2 * b.column(3).to_numpy(zero_copy_only=False)
        texts = b.column(4).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= _RESIDUES:
                size += len(texts[hi])
                hi += 1
            which, place, code = suffixes(texts[lo:hi])
            which = which + lo
            yield pa.RecordBatch.from_arrays([pa.array(k1[which]), pa.array(code.view(np.int64)), pa.array(cls[which]), pa.array(place * 4 + side[which].astype(np.int64))], names=["k1", "prefix", "class", "spot"])
            lo = hi


def _with_neighbour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by ligand and prefix those that share the prefix with the one before or behind.

    Holds a batch and the one row before it.
    """
    held: pa.RecordBatch | None = None
    linked = False
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        k, p = b.column(0).to_numpy(), b.column(1).to_numpy()
        same = (k[1:] == k[:-1]) & (p[1:] == p[:-1])
        keep = np.zeros(len(k), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= linked
        # The last row waits for the one behind it.
        linked, held = bool(keep[-1]), b.slice(len(k) - 1)
        keep[-1] = False
        yield b.filter(pa.array(keep))
    if held is not None and linked:
        yield held


def _alike(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Starts and ends in ``a`` of the equal spans with ``b`` laid ``shift`` into it; None where the two aren't the same chain."""
    a0, b0 = max(shift, 0), max(-shift, 0)
    ra, rb = len(a) - a0, len(b) - b0
    n = min(ra, rb)
    if a0 > END or b0 > END or abs(ra - rb) > END or n <= 0:
        return None
    equal = np.zeros(n + 2, np.int8)
    equal[1:-1] = a[a0 : a0 + n] == b[b0 : b0 + n]
    if (n - int(np.count_nonzero(equal))) * 100 > PERCENT * n:
        return None
    turns = np.flatnonzero(np.diff(equal)) + a0
    return turns[::2], turns[1::2]


_PAIR = [*_LIGAND, "train_chain", "held_chain"]
_FOUND = "k1 bigint, k2 bigint, k3 int, train_chain binary, held_chain binary, held_length bigint, lo array<int>, hi array<int>"
_TEXTS = 2000


def _found(rows: Iterable[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 8
    kinds = [pa.int64()] * 2 + [pa.int32()] + [pa.binary()] * 2 + [pa.int64()] + [pa.list_(pa.int32())] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(k1, k2, k3, train_chain, held_chain, shift, train_text, held_text)`` those that are the same chain."""
    for b in batches:
        for lo in range(0, b.num_rows, _TEXTS):
            out = []
            for k1, k2, k3, t, h, shift, a, c in zip(*[x.to_pylist() for x in b.slice(lo, _TEXTS).columns]):
                spans = _alike(_codes([c])[0], _codes([a])[0], shift)
                if spans is not None:
                    out.append((k1, k2, k3, t, h, len(c), spans[0].tolist(), spans[1].tolist()))
            yield _found(out)


def _within_reach(classes: DataFrame, chains: DataFrame) -> DataFrame:
    """Classes with another of the other side under their ligand whose text is at most 2 * END longer or shorter, by bands of
    lengths: ``classes`` with ``chain``."""
    sized = classes.join(chains.select("chain_id", F.length("chain").alias("n")), "chain_id").withColumn("band", F.floor(F.col("n") / (2 * END + 1)))
    by = sized.groupBy(*_LIGAND, "band").agg(F.count_if("train").alias("t"), F.count_if("held").alias("h"), F.count_if(F.col("train") & F.col("held")).alias("b"))
    near = by.select(*_LIGAND, F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "t", "h", "b").groupBy(*_LIGAND, "band").agg(*[F.sum(c).alias(c) for c in "thb"])
    # A class of both sides isn't its own neighbour.
    own = (F.col("train") & F.col("held")).cast("int")
    ok = (F.col("train") & (F.col("h") > own)) | (F.col("held") & (F.col("t") > own))
    return sized.join(near, [*_LIGAND, "band"]).where(ok).select(*_LIGAND, "chain_id", "train", "held").join(chains, "chain_id")


def alignments(narrow: DataFrame, chains: DataFrame) -> DataFrame:
    """Each way that two chains under one ligand lie on each other: ``(k1, k2, k3, train_chain, held_chain, held_length,
    lo, hi)``, with starts and ends of the equal spans on the held chain. Written to the shared folder.

    Records with the same ligand and chain are one class, so copies cost nothing here. Equal chains are a match by
    themselves. Suffixes are partitioned by ligand and prefix, so no task holds a ligand; texts are fetched for candidate
    pairs only.
    """
    classes = cut(narrow.groupBy(*_LIGAND, "chain_id").agg(F.max("train").alias("train"), F.max(~F.col("train")).alias("held")), "classes")
    texts = cut(_within_reach(classes, chains).withColumn("class", F.monotonically_increasing_id()), "texts")
    kept = texts.select("k1", "class", "train", "held", "chain").mapInArrow(_suffix_rows, _SUFFIX)
    shared = cut(kept.repartition("k1", "prefix").sortWithinPartitions("k1", "prefix").mapInArrow(_with_neighbour, _SUFFIX), "shared")
    shared = shared.select("k1", "prefix", "class", F.shiftright("spot", 2).alias("place"), (F.col("spot") % 2 == 1).alias("train"), (F.shiftright("spot", 1) % 2 == 1).alias("held"))
    sides = shared.groupBy("k1", "prefix").agg(F.count_if("train").alias("t"), F.count_if("held").alias("h")).where("t > 0 and h > 0")
    cross = shared.join(sides.select("k1", "prefix", F.ceil(F.col("h") / TOGETHER).cast("int").alias("parts")), ["k1", "prefix"])
    held = cross.where("held").select("k1", "prefix", F.pmod(F.xxhash64("class", "place"), "parts").cast("int").alias("part"), F.col("class").alias("h"), F.col("place").alias("held_place"))
    train = cross.where("train").select("k1", "prefix", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("class").alias("t"), "place")
    pairs = train.join(held, ["k1", "prefix", "part"]).where("t <> h").select("t", "h", (F.col("held_place") - F.col("place")).cast("int").alias("shift"))
    pairs = pairs.where(F.abs("shift") <= END).distinct()
    left = texts.select(F.col("class").alias("t"), *_LIGAND, F.col("chain_id").alias("train_chain"), F.col("chain").alias("train_text"))
    right = texts.select(F.col("class").alias("h"), *[F.col(k).alias(f"_{k}") for k in _LIGAND], F.col("chain_id").alias("held_chain"), F.col("chain").alias("held_text"))
    both = pairs.join(left, "t").join(right, "h").where(" and ".join(f"{k} = _{k}" for k in _LIGAND))
    near = both.select(*_PAIR, "shift", "train_text", "held_text").mapInArrow(_compare, _FOUND)
    equal = classes.where("train and held").join(chains.select("chain_id", F.length("chain").alias("n")), "chain_id")
    equal = equal.select(*_LIGAND, F.col("chain_id").alias("train_chain"), F.col("chain_id").alias("held_chain"), F.col("n").cast("bigint").alias("held_length"), F.array(F.lit(0)).alias("lo"), F.array("n").alias("hi"))
    return cut(near.unionByName(equal), "matches")


def _strays(found: DataFrame, narrow: DataFrame, keys: DataFrame) -> DataFrame:
    """``(smiles_id)`` of the texts under a matched ligand key that are another ligand than the key's first text, atom by atom.

    Keys are hashes of the graphs; this is the exact check behind them.
    """
    used = narrow.join(found.select(*_LIGAND).distinct(), _LIGAND).select(*_LIGAND, "smiles_id").distinct()
    texts = used.join(keys.select("smiles_id", "smiles"), "smiles_id")
    first = texts.groupBy(*_LIGAND).agg(F.min("smiles").alias("first"))

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = same_ligands(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array([not x for x in same], pa.bool_()))], names=["smiles_id"])

    return cut(texts.join(first, _LIGAND).where("smiles <> first").select("smiles_id", "smiles", "first").mapInArrow(other, "smiles_id bigint"), "strays")


def resolved(rows: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Keyed rows and their alignments, the ligand keys exact: different ligands under one hash are told apart by ``k3``."""
    narrow, chains, keys = keyed(rows, **columns)
    while True:
        found = alignments(narrow, chains)
        strays = _strays(found, narrow, keys)
        if strays.isEmpty():
            return narrow, found
        moved = narrow.join(strays.withColumn("_moved", F.lit(1)), "smiles_id", "left")
        narrow = cut(moved.withColumn("k3", F.col("k3") + F.coalesce("_moved", F.lit(0))).drop("_moved"), "keyed")


def overlaps(rows: DataFrame, **columns: str) -> DataFrame:
    """Every pair of a train row and a held-out row with the same ligand and chain: ``(row_id_1, row_id_2)``.

    The smaller row id comes first. Rows of unknown split, without ligand or without chain have no pairs;
    repeated records each have their own; an empty table gives an empty result.
    """
    narrow, found = resolved(rows, **columns)
    pairs = found.select(*_PAIR).distinct()
    t = narrow.where("train").select(*_LIGAND, F.col("chain_id").alias("train_chain"), F.col("row").alias("t"))
    h = narrow.where("not train").select(*_LIGAND, F.col("chain_id").alias("held_chain"), F.col("row").alias("h"))
    out = pairs.join(t, [*_LIGAND, "train_chain"]).join(h, [*_LIGAND, "held_chain"])
    return out.select(F.least("t", "h").alias("row_id_1"), F.greatest("t", "h").alias("row_id_2"))


def links(rows: DataFrame, **columns: str) -> DataFrame:
    """One row per row with a link: ``(row_id, class_id, n_links)``.

    A class is all rows with one ligand and one chain, named by its smallest row; ``n_links`` counts the rows of the other
    side whose chain is the same or nearly so. Copies aren't expanded into pairs.
    """
    narrow, found = resolved(rows, **columns)
    sizes = cut(narrow.groupBy(*_LIGAND, "chain_id").agg(F.min("row").alias("class_id"), F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_held")), "sizes")
    pairs = cut(found.select(*_PAIR).distinct(), "pairs")
    n = sizes.select(*_LIGAND, "chain_id", "n_train", "n_held")
    held = pairs.join(n.withColumnRenamed("chain_id", "train_chain"), [*_LIGAND, "train_chain"]).groupBy(*_LIGAND, F.col("held_chain").alias("chain_id")).agg(F.sum("n_train").alias("n_links")).withColumn("train", F.lit(False))
    train = pairs.join(n.withColumnRenamed("chain_id", "held_chain"), [*_LIGAND, "held_chain"]).groupBy(*_LIGAND, F.col("train_chain").alias("chain_id")).agg(F.sum("n_held").alias("n_links")).withColumn("train", F.lit(True))
    by = held.unionByName(train).join(sizes.select(*_LIGAND, "chain_id", "class_id"), [*_LIGAND, "chain_id"])
    return narrow.join(by, [*_LIGAND, "chain_id", "train"]).select(F.col("row").alias("row_id"), "class_id", "n_links")


def coverage(rows: DataFrame) -> DataFrame:
    """One row per held-out row that some train row overlaps: ``(row_id, train_rows, covered)``.

    ``covered`` is the share of its chain that train chains under the same ligand repeat, each where it
    lies on the held chain as the same chain: the equal spans of all of them united.
    """
    narrow, found = resolved(rows)
    at = [*_LIGAND, "held_chain"]
    n = narrow.where("train").groupBy(*_LIGAND, F.col("chain_id").alias("train_chain")).agg(F.count("*").alias("n"))
    by = found.select(*_PAIR).distinct().join(n, [*_LIGAND, "train_chain"]).groupBy(*at).agg(F.sum("n").alias("train_rows"))
    # Of spans with one start the longest holds the others, so no held chain has more of them than residues.
    spans = found.select(*at, "held_length", F.inline(F.arrays_zip("lo", "hi"))).groupBy(*at, "lo").agg(F.max("hi").alias("hi"), F.max("held_length").alias("held_length"))
    before = F.max("hi").over(Window.partitionBy(*at).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.greatest(F.col("hi") - F.greatest("lo", F.coalesce(before, F.lit(0))), F.lit(0)))
    share = new.groupBy(*at).agg((F.sum("new") / F.max("held_length")).alias("covered"))
    by = by.join(share, at).withColumnRenamed("held_chain", "chain_id")
    return narrow.where("not train").join(by, [*_LIGAND, "chain_id"]).select(F.col("row").alias("row_id"), "train_rows", "covered")


def report(rows: DataFrame) -> DataFrame:
    """Rows and overlapped rows of each held-out split, source and year (null where the year is missing)."""
    hit = coverage(rows).select(F.col("row_id").alias("_row"), F.lit(1).alias("hit"), (F.col("covered") == 1).cast("int").alias("full"))
    base = rows.where(F.lower(F.trim(F.col("split_name"))).isin("val", "test")).select(F.col("row_id").alias("_row"), "split_name", "source", "year")
    j = base.join(hit, "_row", "left")
    return j.groupBy("split_name", "source", "year").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_overlapping"), F.coalesce(F.sum("full"), F.lit(0)).alias("n_fully_covered"))
