"""Budgets of the parts that cannot look at all rows or all pairs of columns, by mode and shape."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("quick", "standard", "deep", "research")
#: Rows that models of the anomaly ensemble are fitted on, and cells of a profile in memory at once, in the lightest mode; each mode doubles them.
FIT_ROWS, CELLS = 1_024, 64_000_000


@dataclass(frozen=True)
class Budget:
    mode: str
    scale: str
    limits: dict[str, int]


def scale_class(rows: int, columns: int) -> str:
    cells = rows * columns
    if rows >= 100_000_000 or columns >= 100_000 or cells >= 10**12:
        return "extreme"
    if rows >= 10_000_000 or columns >= 10_000 or cells >= 10**10:
        return "very_large"
    if columns >= 1_000:
        return "wide"
    return "large" if rows >= 100_000 or cells >= 10_000_000 else "normal"


def derive_budget(rows: int, columns: int, mode: str = "standard") -> Budget:
    """fit_rows: rows a model is fitted on; pairs: category pairs tested; columns: columns that all-pairs parts take."""
    if mode not in MODES:
        raise ValueError(f"a mode is one of {', '.join(MODES)}")
    step = MODES.index(mode)
    wide = 4 if columns >= 10_000 else 2 if columns >= 1_000 else 1
    limits = {
        "fit_rows": width_aware_rows(max(1, rows), columns, 64 * FIT_ROWS << step, FIT_ROWS << step),
        "pairs": max(5, (10 << step) // wide),
        "deep_columns": 10 << step,
        "columns": column_limit(rows, columns, CELLS << step),
    }
    return Budget(mode, scale_class(rows, columns), limits)


def width_aware_rows(rows: int, columns: int, cells: int, most: int | None = None) -> int:
    """So many rows that rows times columns stays within the cells."""
    return max(1, min(rows, cells // max(1, columns), most if most is not None else rows))


def column_limit(rows: int, columns: int, cells: int, least: int = 32) -> int:
    """So many columns that a driver's part with one fact a cell of a 4,096-row head stays within the cells; `least` at least."""
    return min(columns, max(least, cells // max(1, min(rows, 4_096))))
