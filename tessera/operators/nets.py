"""Layered models of pairs, of labels and of potency ranges, trained in parallel on the executors.

Weights are NumPy arrays. Each round every worker takes one pass over its share of the rows in batches, starting from the common
weights, and the workers' weights are averaged by their rows. A worker reads its rows as a stream of Arrow batches, so its
memory holds a batch and the weights; the driver holds one set of weights per worker, of which there are ``workers``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.persist import cut

FUSIONS = ("concat", "bilinear", "film")
TASKS = ("binary", "labels", "range")


@dataclass(frozen=True)
class Shape:
    """What a model looks like: the width of its first vector and of its second (0 for none), hidden widths, how the two are
    brought together, and its task with so many outputs (labels, or heads times bins)."""

    first: int
    second: int = 0
    hidden: tuple[int, ...] = (64,)
    fusion: str = "concat"
    task: str = "binary"
    outputs: int = 1
    bins: int = 5
    seed: int = 42

    def __post_init__(self) -> None:
        if self.fusion not in FUSIONS or self.task not in TASKS:
            raise ValueError(f"unknown fusion {self.fusion!r} or task {self.task!r}")
        if self.fusion != "concat" and not self.second:
            raise ValueError(f"{self.fusion} needs two vectors")

    @property
    def width(self) -> int:
        return self.outputs * self.bins if self.task == "range" else self.outputs


@dataclass
class Net:
    """A shape and its weights by name."""

    shape: Shape
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def start(shape: Shape) -> Net:
    """Weights drawn by the seed, scaled to the width they read from."""
    rng = np.random.default_rng(shape.seed)

    def layer(name: str, a: int, b: int) -> dict[str, np.ndarray]:
        return {f"{name}.w": rng.normal(0, np.sqrt(2 / a), (a, b)), f"{name}.b": np.zeros(b)}

    w: dict[str, np.ndarray] = {}
    h = shape.hidden[0]
    if shape.fusion == "concat":
        w |= layer("in", shape.first + shape.second, h)
    else:
        w |= layer("first", shape.first, h) | layer("second", shape.second, h)
        if shape.fusion == "film":
            w |= layer("shift", shape.first, h)
    for i, (a, b) in enumerate(zip(shape.hidden, shape.hidden[1:])):
        w |= layer(f"h{i}", a, b)
    return Net(shape, w | layer("out", shape.hidden[-1], shape.width))


def forward(net: Net, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Logits of rows of ``[first | second]``, and what the way back needs."""
    s, w = net.shape, net.weights
    a, b = x[:, : s.first], x[:, s.first :]
    if s.fusion == "concat":
        z = x @ w["in.w"] + w["in.b"]
        kept: list = [(x,)]
    else:
        p, q = a @ w["first.w"] + w["first.b"], b @ w["second.w"] + w["second.b"]
        # Both products; film also moves by what the first vector says.
        z = p * q if s.fusion == "bilinear" else (1 + p) * q + a @ w["shift.w"] + w["shift.b"]
        kept = [(a, b, p, q)]
    h = np.maximum(z, 0)
    kept.append(h)
    for i in range(len(s.hidden) - 1):
        h = np.maximum(h @ w[f"h{i}.w"] + w[f"h{i}.b"], 0)
        kept.append(h)
    return h @ w["out.w"] + w["out.b"], kept


def backward(net: Net, kept: list, d: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all weights from that of the logits."""
    s, w = net.shape, net.weights
    g = {"out.w": kept[-1].T @ d, "out.b": d.sum(0)}
    d = d @ w["out.w"].T
    for i in range(len(s.hidden) - 2, -1, -1):
        d = d * (kept[i + 2] > 0)
        g |= {f"h{i}.w": kept[i + 1].T @ d, f"h{i}.b": d.sum(0)}
        d = d @ w[f"h{i}.w"].T
    d = d * (kept[1] > 0)
    if s.fusion == "concat":
        (x,) = kept[0]
        return g | {"in.w": x.T @ d, "in.b": d.sum(0)}
    a, b, p, q = kept[0]
    dp, dq = d * q, d * (p if s.fusion == "bilinear" else 1 + p)
    g |= {"first.w": a.T @ dp, "first.b": dp.sum(0), "second.w": b.T @ dq, "second.b": dq.sum(0)}
    return g | {"shift.w": a.T @ d, "shift.b": d.sum(0)} if s.fusion == "film" else g


def loss(shape: Shape, logits: np.ndarray, y: np.ndarray, weight: np.ndarray, head: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Loss and its gradient by the logits.

    ``binary`` and ``labels``: cross-entropy, each cell weighted and a NaN label left out. ``range``: cross-entropy over the bins
    of a row's head, averaged by weight within each head, then over the heads that have rows.
    """
    if shape.task != "range":
        mask = np.isfinite(y) * weight.reshape(len(y), -1)
        t = np.nan_to_num(y)
        each = np.maximum(logits, 0) - logits * t + np.log1p(np.exp(-np.abs(logits)))
        total = max(mask.sum(), 1e-8)
        return float((each * mask).sum() / total), (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - t) * mask / total
    cube = logits.reshape(len(logits), shape.outputs, shape.bins)
    at = np.arange(len(logits))
    own = cube[at, head] - cube[at, head].max(1, keepdims=True)
    log_p = own - np.log(np.exp(own).sum(1, keepdims=True))
    by = np.bincount(head, weight, shape.outputs)
    live = max(int((by > 0).sum()), 1)
    share = weight / np.where(by > 0, by, 1)[head] / live
    bins = y.astype(np.int64).reshape(-1)
    d = np.zeros_like(cube)
    soft = np.exp(log_p)
    soft[at, bins] -= 1
    d[at, head] = soft * share[:, None]
    return float(-(log_p[at, bins] * share).sum()), d.reshape(logits.shape)


def _batch(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.array(t["x"].to_pylist(), np.float64)
    y = np.array(t["y"].to_pylist(), np.float64).reshape(len(x), -1)
    return x, y, t["weight"].to_numpy().astype(np.float64), t["head"].to_numpy().astype(np.int64)


def train_pass(net: Net, batches: Iterator[pa.RecordBatch], rate: float, size: int) -> tuple[Net, int]:
    """One pass over a stream of rows in batches of ``size`` by Adam; the new net and its rows."""
    w = {k: v.copy() for k, v in net.weights.items()}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    rows = step = 0
    here = Net(net.shape, w)
    for b in batches:
        t = pa.Table.from_batches([b])
        for lo in range(0, len(t), size):
            x, y, weight, head = _batch(t.slice(lo, size))
            logits, kept = forward(here, x)
            grads = backward(here, kept, loss(net.shape, logits, y, weight, head)[1])
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            rows += len(x)
    return here, rows


def pack(net: Net) -> bytes:
    """A net as one JSON text in bytes, for a file or a column."""
    return json.dumps({"shape": asdict(net.shape), "weights": {k: v.tolist() for k, v in net.weights.items()}}).encode()


def unpack(data: bytes) -> Net:
    d = json.loads(data)
    return Net(Shape(**{**d["shape"], "hidden": tuple(d["shape"]["hidden"])}), {k: np.array(v) for k, v in d["weights"].items()})


def fit(rows: DataFrame, shape: Shape, rounds: int = 20, rate: float = 1e-2, size: int = 256, workers: int = 8, score: Callable[[Net], float] | None = None, patience: int = 5, warm: Net | None = None) -> Net:
    """Train on ``(x, y[, weight][, head])``: ``y`` a number, for ``labels`` a list with NaN or null where a cell doesn't count.

    With ``score``, higher being better, the best round's net is kept and training ends after ``patience`` rounds without a
    better one. ``warm`` is a net to go on from. An empty table gives the net it started from.
    """
    net = warm or start(shape)
    weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    head = F.col("head").cast("int") if "head" in rows.columns else F.lit(0)
    y = F.transform("y", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))) if shape.task == "labels" else F.array(F.col("y").cast("double"))
    x = F.transform("x", lambda v: v.cast("double"))
    ready = cut(rows.select(x.alias("x"), y.alias("y"), weight.alias("weight"), head.alias("head")).repartition(workers), "training")
    best, most, since = net, float("-inf"), 0
    for _ in range(rounds):
        data = pack(net)

        def run(batches: Iterator[pa.RecordBatch], data: bytes = data) -> Iterator[pa.RecordBatch]:
            got, n = train_pass(unpack(data), batches, rate, size)
            if n:
                yield pa.RecordBatch.from_pydict({"net": pa.array([pack(got)], pa.binary()), "n": pa.array([n], pa.int64())})

        parts = [(unpack(bytes(r.net)), r.n) for r in ready.repartition(workers).mapInArrow(run, "net binary, n bigint").collect()]
        if not parts:
            return net
        total = sum(n for _, n in parts)
        net = Net(shape, {k: sum(p.weights[k] * n for p, n in parts) / total for k in net.weights})
        if score is None:
            best = net
            continue
        now = score(net)
        best, most, since = (net, now, 0) if now > most else (best, most, since + 1)
        if since >= patience:
            break
    return best


def predict(net: Net, rows: DataFrame, x: str = "x", out: str = "p") -> DataFrame:
    """All columns and ``out``: the probability, or the list of them by label, or by head and bin for ranges."""
    data = pack(net)
    one = net.shape.task == "binary"

    @F.arrow_udf(DoubleType() if one else ArrayType(DoubleType()))
    def run(v: pa.Array) -> pa.Array:
        here = unpack(data)
        rows = v.to_pylist()
        known = [i for i, r in enumerate(rows) if r is not None]
        got: list = [None] * len(rows)
        if known:
            logits, _ = forward(here, np.array([rows[i] for i in known], np.float64))
            if here.shape.task == "range":
                cube = logits.reshape(len(known), here.shape.outputs, here.shape.bins)
                e = np.exp(cube - cube.max(2, keepdims=True))
                p = (e / e.sum(2, keepdims=True)).reshape(len(known), -1)
            else:
                p = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            for i, q in zip(known, p):
                got[i] = float(q[0]) if one else q
        return pa.array(got, pa.float64() if one else pa.list_(pa.float64()))

    return rows.withColumn(out, run(F.col(x)))


def grid(options: dict[str, list]) -> list[dict[str, object]]:
    """Every combination of the options' values, the last option turning fastest; empty lists are an error."""
    if any(not v for v in options.values()):
        raise ValueError("an option without values")
    out: list[dict[str, object]] = [{}]
    for name, values in options.items():
        out = [{**o, name: v} for o in out for v in values]
    return out


def search(options: dict[str, list], make: Callable[[dict[str, object]], Net], score: Callable[[Net], float]) -> tuple[dict[str, object], Net, float]:
    """The best of all combinations: fitted by ``make``, judged by ``score``, the first on a tie."""
    best: tuple[dict[str, object], Net, float] | None = None
    for o in grid(options):
        net = make(o)
        got = score(net)
        if best is None or got > best[2]:
            best = (o, net, got)
    if best is None:
        raise ValueError("nothing to search")
    return best
