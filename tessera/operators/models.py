"""Models of pairs: trees, linear and layered ones from MLlib on assembled vectors, scored in batches."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics

SEED = 42


def build(kind: str, width: int, weighted: bool = False, **options: object):  # noqa: ANN201
    """An unfitted classifier: ``forest``, ``linear`` or ``layers`` (which knows no weights)."""
    common = {"labelCol": "y", "featuresCol": "features", **({"weightCol": "weight"} if weighted else {})}
    if kind == "forest":
        return RandomForestClassifier(**common, seed=SEED, **({"numTrees": 50, "maxDepth": 8} | options))
    if kind == "linear":
        return LogisticRegression(**common, **({"maxIter": 50, "regParam": 1e-3} | options))
    if kind == "layers":
        if weighted:
            raise ValueError("the layered model takes no weights")
        hidden = options.pop("hidden", (32,))
        return MultilayerPerceptronClassifier(labelCol="y", featuresCol="features", layers=[width, *hidden, 2], seed=SEED, **({"maxIter": 60} | options))
    raise ValueError(f"unknown model {kind!r}")


def fit(train: DataFrame, kind: str, width: int, **options: object) -> Model:
    """Fit on ``(x array, y 0/1[, weight])``."""
    weighted = "weight" in train.columns
    keep = [F.col("y").cast("double").alias("y"), array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features"), *(["weight"] if weighted else [])]
    return build(kind, width, weighted, **options).fit(train.select(*keep))


def score(model: Model, rows: DataFrame, out: str = "p_active") -> DataFrame:
    """All columns and the probability of being active."""
    voted = model.transform(rows.withColumn("features", array_to_vector(F.transform("x", lambda v: v.cast("double")))))
    return voted.withColumn(out, F.element_at(vector_to_array("probability"), 2)).select(*rows.columns, out)


def select_by_macro(fold: DataFrame, candidates: dict[str, Model], group: str) -> tuple[str, float]:
    """The candidate with the best macro AUROC on a fold, by pooled AUROC where no group has both classes; the
    first on a tie."""
    best, most = "", float("-inf")
    for name, model in candidates.items():
        scored = score(model, fold)
        m = metrics.macro(metrics.binary_metrics(scored, [group], "y", "p_active")).first()
        got = m["macro_auroc"] if m["n_evaluable"] else metrics.pooled(scored, "y", "p_active").first()["auroc"]
        if got > most:
            best, most = name, got
    return best, most


def evaluate_folds(df: DataFrame, model: Model, group: str, on: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """``(fold, n, auroc, auprc, ..., macro_auroc, macro_auprc, n_evaluable)`` of a model on folds of ``(x, y, fold, group)``."""
    scored = score(model, df.where(F.col("fold").isin(*on)).select("x", "y", "fold", group))
    pooled = metrics.binary_metrics(scored, ["fold"], "y", "p_active")
    per = metrics.macro(metrics.binary_metrics(scored, ["fold", group], "y", "p_active"), ["fold"])
    return pooled.join(per.select("fold", "n_evaluable", *[f"macro_{m}" for m in metrics.NAMES]), "fold")


def fit_on_fold(df: DataFrame, kind: str, width: int, fold: str = "train", **options: object) -> Model:
    """Fit on the rows of a fold of ``(x, y, fold[, weight])``."""
    return fit(df.where(F.col("fold") == fold).drop("fold"), kind, width, **options)


def grid_search(df: DataFrame, kinds: dict[str, dict[str, list]], width: int, group: str) -> tuple[str, dict[str, object], float]:
    """Kind and options of the best model on the fold ``val`` after a fit on ``train``, by macro AUROC, the first on a tie."""
    from tessera.operators.nets import grid

    tried = [(kind, o) for kind, options in kinds.items() for o in grid(options)]
    held = df.where("fold = 'val'")
    models = {str(i): fit_on_fold(df, kind, width, **o) for i, (kind, o) in enumerate(tried)}
    name, got = select_by_macro(held, models, group)
    return (*tried[int(name)], got)


def save(model: Model, path: str) -> None:
    """Write a model in MLlib's own format, over what is there."""
    model.write().overwrite().save(path)


def load(path: str) -> Model:
    """A model that save wrote, of whatever kind."""
    from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel, RandomForestClassificationModel

    for kind in (RandomForestClassificationModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel):
        try:
            return kind.load(path)
        except Exception as e:  # noqa: BLE001  the reader says only by an error of which kind a model is
            last = e
    raise ValueError(f"no model at {path}") from last
