"""Encoded examples scored by a model in Arrow batches, and evaluated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import text as T
from ..session import materialised
from .encode import OUTPUT_MODES
from .metrics import batch_mean_loss, compute_metrics, cross_entropy, stack_metrics

INPUTS = ("input_ids", "input_mask", "segment_ids")


def score_batches(encoded: DataFrame, make_model, out_col: str = "scores") -> DataFrame:
    """``encoded`` with the model's outputs.  ``make_model()`` runs once a task (it may load a model from the
    shared file system) and returns a function from three integer matrices (ids, mask, segments;
    rows x positions) to rows x outputs."""
    schema = StructType([*encoded.schema.fields, StructField(out_col, ArrayType(DoubleType()))])

    def run(batches):
        model = make_model()
        for pdf in batches:
            if not pdf.empty:
                scores = model(*[np.stack(pdf[c].to_numpy()).astype(np.int64) for c in INPUTS])
                yield pdf.assign(**{out_col: list(np.asarray(scores, dtype=float))})
    return encoded.mapInPandas(run, schema)


def evaluate(encoded: DataFrame, make_model, task: str, order_col: str, label: str = "label", batch_size: int = 8) -> DataFrame:
    """(metric, value): the task's metrics of the model's answers (largest output, or the output itself where the
    task is a regression) and ``eval_loss``, the mean of the losses of consecutive batches."""
    scored = score_batches(encoded.select(order_col, label, *INPUTS), make_model)
    if OUTPUT_MODES[task] == "regression":
        pred = F.col("scores")[0]
        loss = (pred - F.col(label)) ** 2
    else:
        pred, loss = T.argmax("scores"), cross_entropy("scores", label)
    scored = materialised(scored.select(order_col, F.col(label).alias("label"), pred.alias("pred"), loss.alias("loss")), "scored")
    wide = compute_metrics(task, scored)
    rows = stack_metrics(wide, [c for c in wide.columns if c != "rmse"])
    return rows.unionByName(stack_metrics(batch_mean_loss(scored, order_col, "loss", batch_size), ["eval_loss"]))


def hashed_linear_model(classes: int = 2, buckets: int = 11):
    """A small fixed model: output c adds up (id * (3 + 2c) + 7c) mod ``buckets`` over the unmasked positions, over 50."""
    def model(ids, mask, segments):
        return np.stack([(((ids * (3 + 2 * c) + 7 * c) % buckets) * mask).sum(axis=1) / 50.0 for c in range(classes)], axis=1)
    return model
