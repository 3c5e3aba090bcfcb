"""The pair classifier: seven evidence values to unmatched / review / matched."""

from __future__ import annotations

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["iou", "prox", "area_sim", "haus", "attrs", "rel_a", "rel_b"]
CLASSES = ["unmatched", "review", "matched"]
LAYERS = [7, 32, 16, 3]

# Per calibration block, class label, rows and the range of each evidence value.
CALIBRATION = [
    (0, 80, [(0.0, 0.25), (0.0, 0.40), (0.0, 0.45), (0.0, 0.35), (0.0, 0.30), (0.5, 0.95), (0.5, 0.95)]),
    (1, 40, [(0.30, 0.70), (0.45, 0.75), (0.50, 0.85), (0.40, 0.75), (0.35, 0.75), (0.6, 0.95), (0.6, 0.95)]),
    (1, 40, [(0.70, 1.00), (0.70, 1.00), (0.40, 0.65), (0.70, 1.00), (0.00, 0.30), (0.6, 0.95), (0.6, 0.95)]),
    (2, 80, [(0.75, 1.00), (0.78, 1.00), (0.80, 1.00), (0.75, 1.00), (0.65, 1.00), (0.7, 0.98), (0.7, 0.98)]),
]


def calibration(spark: SparkSession) -> DataFrame:
    """The 240 calibration rows, drawn from seeded Spark random columns."""
    blocks = None
    for n, (label, rows, ranges) in enumerate(CALIBRATION):
        draws = [
            (F.rand(42 + 10 * n + i) * (hi - lo) + lo).alias(f) for i, (f, (lo, hi)) in enumerate(zip(FEATURES, ranges))
        ]
        block = spark.range(0, rows, 1, 1).select(F.lit(float(label)).alias("label"), *draws)
        blocks = block if blocks is None else blocks.unionByName(block)
    return blocks


def _vector(df: DataFrame) -> DataFrame:
    clipped = df.withColumns({f"_{f}": F.greatest(F.lit(0.0), F.least(F.col(f), F.lit(1.0))) for f in FEATURES})
    assembler = VectorAssembler(inputCols=[f"_{f}" for f in FEATURES], outputCol="features")
    return assembler.transform(clipped).drop(*[f"_{f}" for f in FEATURES])


def train_pair_model(train: DataFrame, max_iter: int = 20, seed: int = 1) -> MultilayerPerceptronClassificationModel:
    """Early stopping keeps the probabilities graded: a fully trained net saturates at 0 and 1.

    With the default seed an equal pair scores 100, an equal shape with half the area
    stays in the review range and weak evidence scores 0.
    """
    trainer = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=max_iter, seed=seed, blockSize=128)
    return trainer.fit(_vector(train).select("label", "features"))


_models: dict[str, MultilayerPerceptronClassificationModel] = {}


def default_model(spark: SparkSession) -> MultilayerPerceptronClassificationModel:
    """The calibrated model of this application, trained once."""
    key = spark.sparkContext.applicationId
    if key not in _models:
        _models[key] = train_pair_model(calibration(spark).coalesce(1))  # 240 rows
    return _models[key]


def predict_pairs(model: MultilayerPerceptronClassificationModel, df: DataFrame) -> DataFrame:
    """Add mlp_score (0..100), mlp_class and mlp_probabilities."""
    out = model.transform(_vector(df))
    p = vector_to_array("probability")
    out = out.withColumn("_p", p)
    best = F.array_max("_p")
    label = F.when(F.col("_p")[0] == best, CLASSES[0]).when(F.col("_p")[1] == best, CLASSES[1]).otherwise(CLASSES[2])
    score = F.bround(F.col("_p")[2] * 100.0 + F.col("_p")[1] * 60.0, 0).cast("int")
    return out.withColumns(
        {
            "mlp_score": F.greatest(F.lit(0), F.least(score, F.lit(100))),
            "mlp_class": label,
            "mlp_probabilities": F.struct(*[F.round(F.col("_p")[i], 4).alias(c) for i, c in enumerate(CLASSES)]),
        }
    ).drop("features", "rawPrediction", "probability", "prediction", "_p")
