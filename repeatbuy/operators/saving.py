"""Writers and readers of models that are made of other models or of arrays."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)


class SavedModel(Model, MLReadable, MLWritable):
    """A model that is written as its parts, models with writers of their own, and plain facts.

    Subclasses give ``parts()`` and ``facts()``, and build themselves again in ``rebuilt``. A model
    with a table of its own writes it in ``save_table`` and finds its path in ``rebuilt``.
    """

    def parts(self) -> Sequence:
        return []

    def facts(self) -> dict:
        return {}

    def save_table(self, path: str) -> None:
        """Nothing to write."""

    @classmethod
    def rebuilt(cls, facts: dict, parts: Sequence, spark, table: str):
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: SavedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        parts = self.model.parts()
        facts = {"facts": json.dumps(self.model.facts()), "parts": len(parts)}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=facts)
        for i, part in enumerate(parts):
            part.write().save(f"{path}/parts/{i}")
        self.model.save_table(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, kind: type[SavedModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> SavedModel:
        spark = self.sparkSession
        held = DefaultParamsReader.loadMetadata(path, spark)
        parts = [DefaultParamsReader.loadParamsInstance(f"{path}/parts/{i}", spark) for i in range(held["parts"])]
        return self.kind.rebuilt(json.loads(held["facts"]), parts, spark, f"{path}/table")
