"""Two-pass boosted trees with out-of-fold scores, and prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.metrics import best_threshold, f05_curve
from quern.operators.sampling import halves
from quern.operators.windows import assign, context_features
from quern.runtime import stage

KEYS = ("s1", "m", "label", "fold", "half")


def columns_of(features: DataFrame) -> list[str]:
    """All columns but keys and labels, in order."""
    return [c for c in features.columns if c not in KEYS]


@dataclass(frozen=True)
class Params:
    """Learning rate .08, depth 7 (about 127 leaves), 200 rows a leaf, .8 of rows and columns, 255 bins."""

    rounds: int = 60
    depth: int = 7
    step: float = 0.08
    min_rows: int = 200
    subset: str = "0.8"
    rows: float = 0.8
    bins: int = 255
    seed: int = 0
    tolerance: float = 0.001


def assemble(features: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep").transform(features)


def fit(train: DataFrame, columns: list[str], params: Params, validation: DataFrame | None = None) -> GBTClassificationModel:
    """Boosted trees on column ``label``; with a validation table, rounds stop when its loss no longer falls."""
    rows = train.select("label", *columns).withColumn("_v", F.lit(False))
    if validation is not None:
        rows = rows.unionByName(validation.select("label", *columns).withColumn("_v", F.lit(True)))
    model = GBTClassifier(
        featuresCol="_x", labelCol="label", maxIter=params.rounds, maxDepth=params.depth, stepSize=params.step, minInstancesPerNode=params.min_rows,
        featureSubsetStrategy=params.subset, subsamplingRate=params.rows, maxBins=params.bins, seed=params.seed, validationTol=params.tolerance,
    )
    if validation is not None:
        model = model.setValidationIndicatorCol("_v")
    return model.fit(assemble(rows, columns).withColumn("label", F.col("label").cast("double")))


def predict(model: GBTClassificationModel, features: DataFrame, columns: list[str], out: str) -> DataFrame:
    scored = model.transform(assemble(features, columns))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


@dataclass
class TwoPass:
    """Models of both passes; ``first`` holds one per half of the training entities."""

    first: list[GBTClassificationModel]
    second: GBTClassificationModel
    columns: list[str]
    threshold: float = 0.5

    def score(self, features: DataFrame) -> DataFrame:
        """(features..., p1, p1 context, p2): p1 is the mean of the two first models."""
        for h, model in enumerate(self.first):
            features = predict(model, features, self.columns, f"_p{h}")
        features = features.withColumn("p1", (F.col("_p0") + F.col("_p1")) / 2).drop("_p0", "_p1")
        wide = context_features(features, "p1", "p1")
        return predict(self.second, wide, second_columns(self.columns), "p2")

    def match(self, features: DataFrame) -> DataFrame:
        """(s1, matched): the predict step that ends a run on unlabelled data."""
        return assign(self.score(features).select("s1", "m", "p2"), "p2", self.threshold)

    def save(self, path: str) -> None:
        for i, m in enumerate([*self.first, self.second]):
            m.write().overwrite().save(f"{path}/{i}")

    @classmethod
    def load(cls, path: str, columns: list[str], threshold: float) -> TwoPass:
        return cls([GBTClassificationModel.load(f"{path}/{i}") for i in range(2)], GBTClassificationModel.load(f"{path}/2"), columns, threshold)


def second_columns(columns: list[str]) -> list[str]:
    return [*columns, "p1", "p1_rank_in_s1", "p1_gap_s1_best", "p1_rank_in_m", "p1_gap_m_best", "p1_margin_m", "p1_n_s1_for_m"]


def train(features: DataFrame, params: Params = Params(), counts: DataFrame | None = None) -> tuple[TwoPass, DataFrame]:
    """Fit on features (s1, m, label, fold, ...); returns the models and the scored table.

    The training entities are halved by hash; each first model scores the other half, so pass 2 sees out-of-fold scores.
    The validation fold gets the mean of both and tunes the threshold on macro F0.5 if ``counts`` (s1, n_true) is given.
    """
    columns = columns_of(features)
    rows = stage(halves(features, "s1"))
    val = rows.filter("fold = 'val'")
    first = [fit(rows.filter(f"fold = 'train' and half = {h}"), columns, params, val) for h in (0, 1)]
    scored = rows
    for h, model in enumerate(first):
        scored = predict(model, scored, columns, f"_p{h}")
    p1 = F.when(F.col("fold") == "val", (F.col("_p0") + F.col("_p1")) / 2).when(F.col("half") == 0, F.col("_p1")).otherwise(F.col("_p0"))
    wide = stage(context_features(scored.withColumn("p1", p1).drop("_p0", "_p1"), "p1", "p1"))
    cols2 = second_columns(columns)
    second = fit(wide.filter("fold = 'train'"), cols2, params, wide.filter("fold = 'val'"))
    out = predict(second, wide, cols2, "p2")
    models = TwoPass(first, second, columns)
    if counts is not None:
        best = best_threshold(f05_curve(out.filter("fold = 'val'").withColumn("p", F.col("p2")), counts)).first()
        models.threshold = float(best["threshold"])
    return models, out


def importances(model: GBTClassificationModel, columns: list[str], top: int = 30) -> list[tuple[str, float]]:
    shares = model.featureImportances.toArray().tolist()
    return sorted(zip(columns, shares, strict=True), key=lambda x: (-x[1], x[0]))[:top]
