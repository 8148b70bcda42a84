"""Chi-square feature selection as a fitted, storable pipeline stage.

The statistic that is checked (:func:`shoppulse.operators.features.chi2_table`)
is the one that selects.  The fitted stage holds the training columns in their
order and the selected ones, so a pipeline that contains it can be written,
read back and applied to a target table named like the training table.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from shoppulse.operators.features import rank_features, top_feature_count


class _Names(HasInputCols, HasLabelCol, HasOutputCol):
    pass


class ChiSquareSelection(Estimator, _Names, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the ``int(alpha * d)`` columns that depend most on the label and
    assembles them into ``outputCol``."""

    alpha = Param(Params._dummy(), "alpha", "share of the columns to keep", TypeConverters.toFloat)
    buckets = Param(Params._dummy(), "buckets", "equal-width bins of a column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="fvec", labelCol="label", alpha=0.9, buckets=10):
        super().__init__()
        self._setDefault(outputCol="fvec", labelCol="label", alpha=0.9, buckets=10)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "ChiSquareSelectionModel":
        cols = self.getInputCols()
        n = top_feature_count(self.getOrDefault(self.alpha), len(cols))
        ranked = rank_features(dataset, cols, self.getLabelCol(), self.getOrDefault(self.buckets))
        best = {r["feature"] for r in ranked.limit(n).collect()}  # column names
        return ChiSquareSelectionModel(inputCols=cols, outputCol=self.getOutputCol(), labelCol=self.getLabelCol(),
                                       selected=[c for c in cols if c in best])


class ChiSquareSelectionModel(Model, _Names, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted stage: training columns (``inputCols``) and ``selected`` ones, in training order."""

    selected = Param(Params._dummy(), "selected", "columns that are kept", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="fvec", labelCol="label", selected=None):
        super().__init__()
        self._setDefault(outputCol="fvec", labelCol="label")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def getSelected(self) -> list[str]:
        return self.getOrDefault(self.selected)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from shoppulse.operators.features import assemble
        return assemble(dataset, self.getSelected(), self.getOutputCol())
