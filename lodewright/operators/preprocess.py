"""The preprocessing steps in their fixed order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from lodewright.operators.binning import KBinHandler
from lodewright.operators.duplicates import DuplicateHandler
from lodewright.operators.missing import MissingHandler
from lodewright.operators.outliers import MultivariateOutliersHandler, UnivariateOutliersHandler
from lodewright.operators.scaling import Rescaler
from lodewright.operators.variance import LowVarianceHandler
from lodewright.session import Scratch

STEPS = ("duplicate", "missing", "lowvar", "univ_outlier", "kbin", "multiv_outlier", "rescaler")


@dataclass(frozen=True)
class DataPreprocessor:
    """Fits each step on the output of those before it. Outputs are written between steps, because each fit reads its
    input several times."""

    duplicate: DuplicateHandler = field(default_factory=DuplicateHandler)
    missing: MissingHandler = field(default_factory=MissingHandler)
    lowvar: LowVarianceHandler = field(default_factory=LowVarianceHandler)
    univ_outlier: UnivariateOutliersHandler = field(default_factory=UnivariateOutliersHandler)
    kbin: KBinHandler = field(default_factory=KBinHandler)
    multiv_outlier: MultivariateOutliersHandler = field(default_factory=MultivariateOutliersHandler)
    rescaler: Rescaler = field(default_factory=Rescaler)

    def fit(self, df: DataFrame) -> DataPreprocessor:
        return self.fit_transform(df)[0]

    def fit_transform(self, df: DataFrame) -> tuple[DataPreprocessor, DataFrame]:
        scratch = Scratch(df.sparkSession)
        done = {}
        for name in STEPS:
            done[name] = getattr(self, name).fit(df)
            df = scratch.save(done[name].transform(df))
        return replace(self, **done), df

    def transform(self, df: DataFrame) -> DataFrame:
        for name in STEPS:
            df = getattr(self, name).transform(df)
        return df

    def params(self) -> dict:
        """Settings as `step__name`."""
        return {f"{s}__{k}": v for s in STEPS for k, v in vars(getattr(self, s)).items()}

    def shapes(self, df: DataFrame) -> DataFrame:
        """(`stage`, `n_rows`, `n_cols`): the ledger of shapes after each fitted step."""
        rows = [("original", df.count(), len(df.columns))]
        for name in STEPS:
            df = getattr(self, name).transform(df)
            rows.append((name, df.count(), len(df.columns)))
        return df.sparkSession.createDataFrame(rows, "stage string, n_rows long, n_cols int")
