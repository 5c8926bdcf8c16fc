"""Length of the longest common subsequence of two token lists, bit-parallel (Hyyrö 2004)."""

from __future__ import annotations

from collections.abc import Sequence


def common_length(left: Sequence[str], right: Sequence[str]) -> int:
    """One machine word covers 64 cells of the classic table, so whole long texts stay cheap."""
    at: dict[str, int] = {}
    for position, token in enumerate(left):
        at[token] = at.get(token, 0) | (1 << position)
    full = (1 << len(left)) - 1
    open_cells = full
    for token in right:
        met = open_cells & at.get(token, 0)
        open_cells = ((open_cells + met) | (open_cells - met)) & full
    return len(left) - open_cells.bit_count()
