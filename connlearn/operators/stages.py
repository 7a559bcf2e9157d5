"""A Spark ML stage that maps raw labels to class ids.

It sits in front of the feature stages, so a fitted ``PipelineModel`` carries
its label vocabulary and can be saved, reloaded and applied to raw records as
a whole. Its transform is a column expression (no job, no join), so it also
runs on streaming frames.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NORMAL_TOKEN, binary_class, vocabulary_class
from .labels import DEFAULT_MAX_CLASSES, collect_vocabulary, label_vocabulary

CLASS_MODES = ("binary", "all")
# Class names of the binary problem.
BINARY_CLASS_NAMES = ["normal", "attack"]


class _ClassLabelerParams(HasInputCol, HasOutputCol):
    classes = Param(Params._dummy(), "classes", "'binary' (normal/attack) or 'all' (one class per label)",
                    typeConverter=TypeConverters.toString)
    normalToken = Param(Params._dummy(), "normalToken", "substring marking a normal label",
                        typeConverter=TypeConverters.toString)
    match = Param(Params._dummy(), "match", "'contains' or 'exact' vocabulary matching",
                  typeConverter=TypeConverters.toString)
    dropUnknown = Param(Params._dummy(), "dropUnknown", "drop rows whose label is not in the vocabulary",
                        typeConverter=TypeConverters.toBoolean)
    maxClasses = Param(Params._dummy(), "maxClasses", "largest accepted vocabulary",
                       typeConverter=TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(inputCol="label", outputCol="class", classes="binary", normalToken=NORMAL_TOKEN,
                         match="contains", dropUnknown=True, maxClasses=DEFAULT_MAX_CLASSES)


class ClassLabeler(Estimator, _ClassLabelerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fit the label vocabulary (``classes='all'``) or check both binary
    classes occur (``classes='binary'``)."""

    @keyword_only
    def __init__(self, *, inputCol="label", outputCol="class", classes="binary", normalToken=NORMAL_TOKEN,
                 match="contains", dropUnknown=True, maxClasses=DEFAULT_MAX_CLASSES):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ClassLabelerModel":
        mode = self.getOrDefault(self.classes)
        if mode not in CLASS_MODES:
            raise ValueError(f"classes must be one of {CLASS_MODES}")
        label = self.getInputCol()
        if mode == "binary":
            present = [r[0] for r in dataset.select(binary_class(label, self.getOrDefault(self.normalToken))
                                                    .alias("c")).distinct().collect()]
            if len(present) < 2:
                only = BINARY_CLASS_NAMES[int(present[0])] if present else "none"
                raise ValueError(f"training data holds a single class: {only}")
            vocab = list(BINARY_CLASS_NAMES)
        else:
            vocab = collect_vocabulary(label_vocabulary(dataset, label), self.getOrDefault(self.maxClasses))
            if len(vocab) < 2:
                raise ValueError(f"training data holds a single class: {vocab[0] if vocab else 'none'}")
        model = ClassLabelerModel(vocabulary=vocab)
        return self._copyValues(model)


class ClassLabelerModel(Model, _ClassLabelerParams, DefaultParamsReadable, DefaultParamsWritable):
    vocabulary = Param(Params._dummy(), "vocabulary", "class names; position = class id",
                       typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, vocabulary=None):
        super().__init__()
        if vocabulary is not None:
            self._set(vocabulary=vocabulary)

    def getVocabulary(self) -> list[str]:
        return list(self.getOrDefault(self.vocabulary))

    @property
    def numClasses(self) -> int:
        return len(self.getVocabulary())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        label, out = self.getInputCol(), self.getOutputCol()
        if label not in dataset.columns:      # unlabelled records (scoring)
            return dataset
        if self.getOrDefault(self.classes) == "binary":
            return dataset.withColumn(out, binary_class(label, self.getOrDefault(self.normalToken)))
        res = dataset.withColumn(out, vocabulary_class(label, self.getVocabulary(), self.getOrDefault(self.match)))
        return res.filter(F.col(out) >= 0) if self.getOrDefault(self.dropUnknown) else res
