"""An optional learned confirmer of crops: loaded once a worker; without a model file there is no opinion."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pixels


def probability(model: str | None, height: Column, width: Column, data: Column, side: int = 64) -> Column:
    """The model's probability for grey crops, or null without one. model is an ONNX file that workers can open, with one
    input (n, 1, side, side) and logits as output."""
    if not model or not Path(model).exists():
        return F.lit(None).cast("double")

    @F.pandas_udf("double")
    def judge(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for h, w, d in it:
            crops = [pixels.crop_input(np.frombuffer(x, np.uint8).reshape(a, b), side) for a, b, x in zip(h, w, d, strict=True)]
            logits = session.run(None, {name: np.stack(crops)[:, None].astype(np.float32)})[0].reshape(len(crops), -1)
            top = np.exp(logits - logits.max(1, keepdims=True))
            yield pd.Series(1 / (1 + np.exp(-logits[:, 0])) if logits.shape[1] == 1 else top[:, -1] / top.sum(1))

    return judge(height, width, data)
