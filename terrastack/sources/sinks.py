"""Where results go: one plan, worked out once, to the sinks that parameters name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from terrastack.operators import raster_blocks
from terrastack.operators.grid import GridSpec
from terrastack.sources.partitioned import write_by_keys
from terrastack.sources.shared import shared_folder

TARGETS = ("table", "cells", "blocks", "report")


@dataclass(frozen=True)
class ExportParams:
    """targets: what is written, under `root`. table: all columns in folders by `keys`. cells: grid_row, grid_col and `value` as rows. blocks: the same as arrays (`maps` False leaves both maps out).
    report: one CSV file of `selectors`, for tables of a few dozen rows."""

    root: str
    targets: tuple[str, ...] = ("table",)
    keys: tuple[str, ...] = ("state", "year", "month")
    selectors: tuple[str, ...] = ()
    value: str = "value"
    maps: bool = True
    mode: str = "errorifexists"

    def __post_init__(self) -> None:
        unknown = [t for t in self.targets if t not in TARGETS]
        if unknown or not self.targets:
            raise ValueError(f"targets must be some of {', '.join(TARGETS)}, not {', '.join(unknown) or 'none'}")
        if "report" in self.targets and not self.selectors:
            raise ValueError("a report needs selectors")
        if self.mode not in ("errorifexists", "overwrite"):
            raise ValueError(f"mode must be 'errorifexists' or 'overwrite', not {self.mode!r}")


def export(result: DataFrame, params: ExportParams, grid: GridSpec | None = None) -> dict[str, str]:
    """Writes `result` to each target and returns where. With several targets it is worked out once, in the checkpoint folder."""
    wanted = [t for t in dict.fromkeys(params.targets) if params.maps or t not in ("cells", "blocks")]
    if "blocks" in wanted and grid is None:
        raise ValueError("blocks need a grid")
    absent = [c for t, columns in (("table", params.keys), ("report", params.selectors), ("cells", (params.value,)), ("blocks", (params.value,))) if t in wanted for c in columns if c not in result.columns]
    if absent:
        raise ValueError(f"the result lacks {', '.join(absent)}")
    if len(wanted) > 1:
        shared_folder(result.sparkSession)
        result = result.checkpoint()
    places = {t: f"{params.root}/{t}" for t in wanted}
    for target, path in places.items():
        if target == "table":
            write_by_keys(result, path, list(params.keys), params.mode)
        elif target == "cells":
            result.select("grid_row", "grid_col", params.value).write.mode(params.mode).parquet(path)
        elif target == "blocks":
            raster_blocks.to_blocks(result, grid, params.value).write.mode(params.mode).parquet(path)
        else:
            result.select(*params.selectors).coalesce(1).write.mode(params.mode).csv(path, header=True)
    return places
