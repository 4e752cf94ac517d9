"""The wide feature table: rows with an id, numeric features, labels and feature groups."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class FeatureTable:
    df: DataFrame
    features: list[str]
    id_col: str = "row_id"
    groups: dict[str, list[str]] = field(default_factory=dict)
    tasks: dict[str, str] = field(default_factory=dict)
    strat_col: str | None = None
    name: str = "table"

    def with_df(self, df: DataFrame) -> "FeatureTable":
        return replace(self, df=df)

    def group_of(self, feature: str) -> str | None:
        for g, members in self.groups.items():
            if feature in members:
                return g
        return None

    def features_df(self) -> DataFrame:
        """Dimension table (pos, feature, group)."""
        rows = [(i, f, self.group_of(f)) for i, f in enumerate(self.features)]
        return self.df.sparkSession.createDataFrame(rows, "pos int, feature string, `group` string")

    def to_double(self) -> "FeatureTable":
        keep = [c for c in self.df.columns if c not in self.features]
        return self.with_df(self.df.select(*keep, *[F.col(f).cast("double").alias(f) for f in self.features]))


def numeric_columns(df: DataFrame, deny: list[str] = ()) -> list[str]:
    """Numeric columns outside the deny-list, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in deny]
