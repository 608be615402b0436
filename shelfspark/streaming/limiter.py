"""The sign-in limit as a rule on the failures of a key.

Only the last ``max_failures`` failures since the last clearing matter: if the oldest of them lies within the window
before an attempt, that attempt begins a block. A success clears them, and so does a block.
"""

from __future__ import annotations

from collections.abc import Iterable


def answers(attempts: Iterable[tuple[float, str]], last: list[float], end: float, max_failures: int, window: float, block: float) -> tuple[list[tuple[bool, int]], list[float], float]:
    """((allowed, seconds to wait) of each attempt (time, outcome) in order, the last failures, the end of the block), from the two before."""
    out = []
    for at, outcome in attempts:
        wait = 0
        if at < end:
            wait = int(end - at) + 1
        elif len(last) == max_failures and (not last or last[0] >= at - window):
            wait, end, last = int(block), at + block, []
        elif outcome == "failure":
            last = [*last, at][-max_failures:]
        elif outcome == "success":
            last = []
        out.append((wait == 0, wait))
    return out, last, end
