"""SQL texts that several queries share."""

from __future__ import annotations


def greedy_sql(blocks: str, shares: dict[str, float], before: str = "", name: str = "fold") -> str:
    """Rows and blocks of each fold when blocks go largest first, each to the fold that lacks most.

    ``blocks`` selects one row per block with its rows as ``n``. One step of the recursion per block, so for small tables.
    """
    folds = list(shares)
    at = [f"l{i}" for i in range(len(folds))]
    most = f"greatest({', '.join(at)})"
    first = [" AND ".join([f"{a} = {most}", *[f"{b} < {most}" for b in at[:i]]]) for i, a in enumerate(at)]
    down = ", ".join(f"CASE WHEN {w} THEN {a} - n ELSE {a} END AS {a}" for a, w in zip(at, first))
    which = "CASE " + " ".join(f"WHEN {w} THEN {i}" for i, w in enumerate(first)) + " END"
    start = ", ".join(f"{s!r}::DOUBLE * (SELECT sum(n) FROM sized) AS {a}" for a, s in zip(at, shares.values()))
    names = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(folds))
    return f"""WITH RECURSIVE {before + "," if before else ""} sized AS ({blocks}), ordered AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM sized),
    step AS (SELECT 0::BIGINT AS k, -1 AS fold, 0::BIGINT AS rows, {start} UNION ALL SELECT o.k, {which}, n, {down} FROM step JOIN ordered o ON o.k = step.k + 1)
    SELECT CASE fold {names} END AS {name}, CAST(sum(rows) AS BIGINT) AS n_rows, count(*) AS n_units FROM step WHERE k > 0 GROUP BY fold"""
