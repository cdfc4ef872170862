"""Column selection, feature typing and missing-value markers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgrid.fixed import PD_CATEGORICAL, PD_NUMERIC, SENTINELS
from lossgrid.functions.scalars import parse_numeric_status


def select_as(df: DataFrame, mapping: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Project columns, renaming `source -> name` where a mapping is given."""
    pairs = mapping.items() if isinstance(mapping, Mapping) else [(c, c) for c in mapping]
    return df.select(*[F.col(source).alias(name) for source, name in pairs])


def without_markers(name: str, profile: str) -> Column:
    """A column with the profile's markers as NULL."""
    c = F.col(name)
    for marker in SENTINELS[profile].get(name, ()):
        c = F.nullif(c, F.lit(marker))
    return c.alias(name)


def clean_sentinels(df: DataFrame, profile: str = "unified") -> DataFrame:
    """Turn the profile's markers into NULL in every column that is present."""
    return df.withColumns({c: without_markers(c, profile) for c in df.columns if c in SENTINELS[profile]})


def type_features(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The model columns of a labelled panel and further `keys`, with the delinquency code as a number."""
    known = ("loan_identifier", "observation_month", "default_12m", "copies", *keys)
    keys = [c for c in known if c in panel.columns]
    typed = panel.withColumn(
        "delinquency_status_numeric", parse_numeric_status("current_loan_delinquency_status")
    )
    extra = [c for c in ("loan_age", "months_to_legal_maturity") if c in panel.columns]
    return typed.select(*keys, *PD_NUMERIC, *extra, *PD_CATEGORICAL)


def model_data(panel: DataFrame, profile: str = "train", keys: Sequence[str] = ()) -> DataFrame:
    """Typed and cleaned modelling rows; two projections that the optimizer folds into one."""
    return clean_sentinels(type_features(panel, keys), profile)


def fill_flags(df: DataFrame, columns: Sequence[str], value: str = "None") -> DataFrame:
    return df.fillna({c: value for c in columns})
