"""Run parameters, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CompositeParams:
    """How monthly composites are made. Only 'median' and 'mean' reduce; anything else is refused."""

    cloud_limit: float = 50.0
    nonveg: bool = False
    reducer: str = "median"
    encode_scale: float = 100.0
    version: str = "0.2.0"

    def __post_init__(self) -> None:
        if self.reducer not in ("median", "mean"):
            raise ValueError(f"reducer must be 'median' or 'mean', not {self.reducer!r}")
        if self.encode_scale <= 0:
            raise ValueError("encode_scale must be positive")


@dataclass(frozen=True)
class DensityParams:
    """Years that means are taken over, cloud limit, and whether pixels without observations count as 0."""

    first_year: int = 2000
    last_year: int = 2022
    cloud_limit: float = 50.0
    zero_fill: bool = True

    def __post_init__(self) -> None:
        if self.first_year > self.last_year:
            raise ValueError("first_year is after last_year")

    @property
    def years(self) -> int:
        return self.last_year - self.first_year + 1


RESAMPLING = ("nearest", "bilinear", "average")


@dataclass(frozen=True)
class MosaicParams:
    """prefer 'src' keeps the last valid tile of a cell, 'dest' the first. A scale of None or 1 leaves values as they are. resampling: how tiles are brought onto the grid."""

    prefer: str = "src"
    scale: float | None = 0.01
    nodata: float | None = -9999.0
    resampling: str = "nearest"

    def __post_init__(self) -> None:
        if self.prefer not in ("src", "dest"):
            raise ValueError(f"prefer must be 'src' or 'dest', not {self.prefer!r}")
        if self.resampling not in RESAMPLING:
            raise ValueError(f"resampling must be one of {', '.join(RESAMPLING)}, not {self.resampling!r}")


@dataclass(frozen=True)
class ForestParams:
    """Random-forest regression: trees, rows in a leaf at least, features tried at a split, seed."""

    trees: int = 100
    min_leaf: int = 50
    split_features: int = 5
    seed: int = 42
    pool_biomes: bool = False
