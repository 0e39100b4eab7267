"""Mixtures of named sources with options and per-split limits."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators.merge import concat_by_split
from evalweave.operators.select import limit_split, limit_split_stream

# A loader gets a source's options and gives rows with `split` and the order key.
Loader = Callable[[dict[str, str]], tuple[DataFrame, list[str]]]


@dataclass(frozen=True)
class SourceSpec:
    name: str
    options: dict[str, str] = field(default_factory=dict)
    limits: dict[str, int] = field(default_factory=dict)


def spec_of(text: str) -> SourceSpec:
    """`name[key:value,split:1_000]`: whole numbers are limits, the rest options."""
    name, _, inner = text.strip().partition("[")
    options, limits = {}, {}
    for entry in filter(None, (e.strip() for e in inner.rstrip("]").split(","))):
        key, colon, value = (p.strip() for p in entry.partition(":"))
        if not colon:
            raise ValueError(f"{entry!r} in {text!r} should be key:value")
        if re.fullmatch(r"\d(_?\d)*", value):
            limits[key] = int(value)
        else:
            options[key] = value
    return SourceSpec(name.strip(), options, limits)


def specs_of(text: str) -> list[SourceSpec]:
    """Sources joined by `+` or `|`."""
    specs = [spec_of(part) for part in re.split(r"[+|]", text) if part.strip()]
    if not specs:
        raise ValueError("no source is named")
    return specs


def load_mixture(specs: list[SourceSpec], loaders: dict[str, Loader], key: str, ordered_reader: bool = False) -> DataFrame:
    """Load each source, limit its splits, and put the parts together by split.

    With `ordered_reader` the limits of one split do not overlap.
    """
    parts = []
    for s in specs:
        if s.name not in loaders:
            raise ValueError(f"unknown source {s.name!r}; known: {sorted(loaders)}")
        rows, splits = loaders[s.name](s.options)
        limit = limit_split_stream if ordered_reader else limit_split
        parts.append(limit(rows, s.limits, key, splits).withColumn("source_name", F.lit(s.name)))
    return concat_by_split(*parts)


def load_all_configs(configs: dict[str, Callable[[], DataFrame]], name: str | None = None) -> DataFrame:
    """One configuration, or all of them, each row with its configuration."""
    if name is not None:
        return configs[name]().withColumn("config", F.lit(name))
    if not configs:
        raise ValueError("the source has no configurations")
    return concat_by_split(*[load().withColumn("config", F.lit(c)) for c, load in configs.items()])
