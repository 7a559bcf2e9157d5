"""The end-to-end learning workflow: raw records in, fitted pipeline,
scored test records and evaluation tables out.

``Workflow(categorical=False|True, classes='binary'|'all')`` covers the four
variants (numeric or numeric + one-hot features, normal/attack or one class
per attack type).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame

from ..functions.columns import NORMAL_TOKEN
from ..operators.diagnose import Separation, score_equations
from ..operators.evaluate import confusion_counts, confusion_matrix, error_rate, ok_ko_counts, prediction_pairs
from ..operators.labels import class_frequency
from ..operators.model import (MAX_ITER, TOLERANCE, build_pipeline, fit_checked, labeler_of, load_model, lr_weights,
                               save_model)
from ..schema import RecordSchema
from ..session import ensure_checkpoint_dir


@dataclass
class WorkflowResult:
    model: PipelineModel
    scored: DataFrame
    pairs: DataFrame
    vocabulary: list[str]
    feature_names: list[str] = field(default_factory=list)

    @property
    def num_classes(self) -> int:
        return len(self.vocabulary)

    def ok_ko(self) -> DataFrame:
        return ok_ko_counts(self.pairs)

    def error(self) -> DataFrame:
        return error_rate(self.pairs)

    def confusion_counts(self) -> DataFrame:
        return confusion_counts(self.pairs)

    def confusion_matrix(self, form: str = "long") -> DataFrame:
        return confusion_matrix(self.pairs, self.num_classes, form=form)

    def class_frequency(self) -> DataFrame:
        return class_frequency(self.scored, self.vocabulary, "class")

    def weights(self, form: str = "pivoted") -> DataFrame:
        return lr_weights(self.model, self.scored.sparkSession, self.feature_names or None, form=form)

    def persist(self) -> "WorkflowResult":
        """Keep the (two-column) prediction pairs, so several evaluation
        tables score the test data once."""
        self.pairs = self.pairs.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> "WorkflowResult":
        self.pairs.unpersist()
        return self


@dataclass
class Workflow:
    schema: RecordSchema
    categorical: bool = True
    classes: str = "binary"
    normal_token: str = NORMAL_TOKEN
    match: str = "contains"
    max_iter: int = MAX_ITER
    tol: float = TOLERANCE
    durable: bool = False
    cache: bool = True
    on_separable: str = "flag"
    separation: Separation | None = field(default=None, init=False)

    def pipeline(self):
        return build_pipeline(self.schema, categorical=self.categorical, classes=self.classes,
                              normal_token=self.normal_token, match=self.match,
                              max_iter=self.max_iter, tol=self.tol)

    def fit(self, train: DataFrame) -> PipelineModel:
        """Fit on ``train`` only.

        The columns of the training frame that are used are persisted (memory, spilling to disk) for the
        passes of the label, indexer, scaler and optimiser fits, unless the
        caller already cached it; it is released afterwards. With
        ``durable=True`` it is checkpointed to the shared checkpoint folder
        instead (lineage cut); with ``cache=False`` it is read again for
        every pass. The optimiser
        caches its own standardised instance blocks, so the feature vectors
        are not cached a second time.
        """
        if self.durable:
            # reliable checkpoint in the shared spark.checkpoint.dir: a lost
            # executor re-reads these files instead of re-running the lineage
            # (for gzip text, one task over the whole file)
            ensure_checkpoint_dir(train.sparkSession)
            return self._fit(train.checkpoint(eager=True))
        if not self.cache:
            # e.g. training data staged as Parquet: each pass re-reads the
            # pruned columns instead of holding a copy next to the
            # optimiser's own cached blocks
            return self._fit(train)
        level = train.storageLevel
        used = [*self.schema.numeric, self.schema.label, *(self.schema.categorical if self.categorical else ())]
        own_cache = not (level.useMemory or level.useDisk or level.useOffHeap)
        source = train.select(*used).persist(StorageLevel.MEMORY_AND_DISK) if own_cache else train
        try:
            return self._fit(source)
        finally:
            if own_cache:
                source.unpersist()

    def _fit(self, train: DataFrame) -> PipelineModel:
        """Feature stages, then the optimiser under :func:`fit_checked`."""
        *stages, lr = self.pipeline().getStages()
        head = Pipeline(stages=stages).fit(train)
        model, self.separation = fit_checked(lr, head.transform(train), self.on_separable)
        return PipelineModel(stages=[*head.stages, model])

    def score_equations(self, model: PipelineModel, train: DataFrame) -> DataFrame:
        """Both sides of the score equations of a fitted model on its training
        rows; see :func:`connlearn.operators.diagnose.score_equations`."""
        return score_equations(model.transform(train), len(labeler_of(model).getVocabulary()), self.feature_names(model))

    def feature_names(self, model: PipelineModel) -> list[str]:
        names = list(self.schema.numeric)
        if self.categorical and self.schema.categorical:
            labels = next((s.labelsArray for s in model.stages if hasattr(s, "labelsArray")), None)
            for col, known in zip(self.schema.categorical, labels or []):
                names += [f"{col}={v}" for v in known] + [f"{col}=<unseen>"]
        return names

    def run(self, train: DataFrame, test: DataFrame, model_path: str | None = None) -> WorkflowResult:
        """Fit, optionally save and reload (scoring then uses the reloaded
        model), score ``test`` and prepare the evaluation tables (lazy)."""
        model = self.fit(train)
        if model_path:
            save_model(model, model_path)
            model = load_model(model_path)
        scored = model.transform(test)
        vocab = labeler_of(model).getVocabulary()
        return WorkflowResult(model=model, scored=scored, pairs=prediction_pairs(scored),
                              vocabulary=vocab, feature_names=self.feature_names(model))
