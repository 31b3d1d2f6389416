"""Training set, classifier and its metrics."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from opinionloom.functions import labels, vocab
from opinionloom.functions import text as txt
from opinionloom.operators import softmax
from opinionloom.sources.shared import workspace

# Our own split rule: md5 spreads row ids evenly, and 0x3333 is one fifth of its 16-bit prefix.
VALIDATION_BELOW = "3333"


def training_set(aspects):
    """Rows with a known label, their class id, and a repeatable 80/20 ``split``."""
    known = aspects.where(F.col("label").isin(*vocab.LABEL_IDS))
    row_id = F.concat_ws("|", "review_id", "sent_pos", "aspect")
    in_validation = F.substring(F.md5(row_id), 1, 4) < VALIDATION_BELOW
    return known.select(
        *aspects.columns,
        labels.label_id(F.col("label")).cast("int").alias("label_id"),
        F.when(in_validation, "validation").otherwise("train").alias("split"),
    )


def with_tokens(pairs, text="text", aspect="aspect"):
    """Words of the text plus one token for the aspect asked about."""
    words = F.array_remove(txt.words(F.coalesce(F.col(text), F.lit(""))), "")
    return pairs.withColumn("_tokens", F.concat(words, F.array(F.concat(F.lit("aspect="), F.col(aspect)))))


def train_classifier(training, dimensions=2**16, penalties=(0.0, 0.01, 0.1), iterations=20):
    """Fit one model per penalty on the training split; the best weighted F1 on validation wins.

    Returns the model and a DataFrame with its metrics.
    """
    # Words are cut and hashed once; the weights, all models and their metrics start from the blocks that are stored here.
    hashing = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dimensions)
    counted = hashing.transform(with_tokens(training)).select("_counts", "label_id", "split")
    context = training.sparkSession.sparkContext
    blocks = softmax.Blocks(softmax.stored_blocks(counted, dimensions, workspace(training.sparkSession).kept), dimensions)
    counts = blocks.counts()
    if (counts.labels > 0).sum() == 0:
        raise ValueError("no rows to train with")
    weights = softmax.weights_model(context, counts, "_counts", "_features")
    if (counts.labels > 0).sum() == 1:
        # Nothing to fit: the last label is certain.
        others = len(counts.labels) - 1
        fitted = [(np.zeros((others + 1, dimensions)), np.where(counts.labels > 0, np.inf, 0.0))] * len(penalties)
        told = np.zeros((len(penalties), others, dimensions)), np.full((len(penalties), others), -1.0)
    else:
        fitted, told = softmax.fit(blocks, counts, penalties, iterations)
    cells = blocks.confusions(*told)
    trials = []
    for m, penalty in enumerate(penalties):
        own = [(r["label"], r["prediction"], r["n"]) for r in cells if r["model"] == m]
        metrics = metrics_of_cells(training.sparkSession.createDataFrame(own, "label int, prediction int, n bigint"))
        score = metrics.first()  # one row
        trials.append((score["f1"] if score["f1"] is not None else -1.0, -penalty, m, score))
    _, _, best, score = max(trials, key=lambda trial: trial[:2])
    model = softmax.regression_model(context, *fitted[best], "_features", "prediction")
    metrics = training.sparkSession.createDataFrame([score], schema=metrics.schema)
    return Classifier(PipelineModel(stages=[hashing, weights]), model), metrics


class Classifier:
    """Fitted features and model, as one transformation."""

    def __init__(self, features, model):
        self.features = features
        self.model = model

    def save(self, path):
        """Write features and model below the path, for ``Classifier.load`` in another session."""
        self.features.write().overwrite().save(f"{path.rstrip('/')}/features")
        self.model.write().overwrite().save(f"{path.rstrip('/')}/model")

    @classmethod
    def load(cls, path):
        return cls(PipelineModel.load(f"{path.rstrip('/')}/features"), LogisticRegressionModel.load(f"{path.rstrip('/')}/model"))

    def predict(self, pairs, text="text", aspect="aspect"):
        """Add ``prediction`` (class id) and ``predicted_label``."""
        scored = self.model.transform(self.features.transform(with_tokens(pairs, text, aspect)))
        names = F.array(*[F.lit(name) for name in vocab.LABEL_IDS])
        return scored.select(
            *pairs.columns,
            F.col("prediction").cast("int").alias("prediction"),
            F.get(names, F.col("prediction").cast("int")).alias("predicted_label"),
        )

    def score_reviews(self, reviews, text="final_review"):
        """Stars and label of each review by this classifier; NULL without a text."""
        scored = self.predict(reviews.withColumn("_aspect", F.lit("")), text, "_aspect")
        stars = labels.stars_of_raw_label(F.when(F.col(text) != "", F.col("predicted_label")))
        return (
            scored.withColumn("sentiment_score", stars)
            .withColumn("sentiment_label", labels.label_of_stars(F.col("sentiment_score")))
            .drop("_aspect", "prediction", "predicted_label")
        )


def confusion(predictions, label="label_id", prediction="prediction"):
    """Rows per true and predicted class."""
    return predictions.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count("*").alias("n"))


def classification_metrics(predictions, label="label_id", prediction="prediction"):
    """One row: accuracy, and precision, recall and F1 weighted by the size of each true class."""
    return metrics_of_cells(confusion(predictions, label, prediction))


def metrics_of_cells(cells):
    """The metrics of the rows of ``confusion``."""
    # Each cell counts for its true class and for its predicted class; a few rows in all.
    none = F.lit(0).cast("bigint")
    right = F.col("label") == F.col("prediction")

    def side(column, true, said):
        return F.struct(F.col(column).alias("class"), true.alias("true"), said.alias("said"), right.alias("right"))

    sides = cells.select(
        F.explode(F.array(side("label", F.col("n"), none), side("prediction", none, F.col("n")))).alias("side")
    ).select("side.*")
    classes = sides.groupBy("class").agg(
        F.sum("true").alias("support"),
        F.sum("said").alias("said"),
        F.sum(F.when(F.col("right"), F.col("true")).otherwise(0)).alias("hits"),
    )
    precision = F.when(F.col("said") > 0, F.col("hits") / F.col("said")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    rated = classes.select("support", "hits", precision.alias("p"), recall.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    total = F.sum("support")
    return rated.withColumn("f", f1).agg(
        (F.sum("hits") / total).alias("accuracy"),
        *[
            (F.sum(F.col(column) * F.col("support")) / total).alias(name)
            for column, name in (("f", "f1"), ("p", "precision"), ("r", "recall"))
        ],
    )
