"""Window kernels: the weight of a context token by its distance from the focal token."""

from __future__ import annotations


def kernel(name: str, window: int | None = None, weights: tuple[list[float], list[float]] | None = None) -> tuple[list[float], list[float]]:
    """(right, left) weights for distances 1, 2, ...; `weights` goes with `custom` alone, `window` with the others."""
    if name == "custom":
        if weights is None or window is not None:
            raise ValueError("a custom kernel takes weights and no window")
        return list(weights[0]), list(weights[1])
    if window is None or weights is not None:
        raise ValueError(f"the kernel {name} takes a window and no weights")
    by_name = {"flat": lambda k: 1.0, "harmonic": lambda k: 1.0 / k, "dynamic": lambda k: (window - k + 1) / window}
    if name not in by_name:
        raise ValueError(f"no kernel is named {name}")
    side = [by_name[name](k) for k in range(1, window + 1)]
    return side, list(side)


def read_weights(text: str) -> tuple[list[float], list[float]]:
    """(right, left) weights of a weights file: two lines of numbers; blank lines and what follows # are left out."""
    rows = [row for line in text.splitlines() if (row := line.split("#")[0].split())]
    if len(rows) != 2:
        raise ValueError(f"a weights file has two lines of numbers, not {len(rows)}")
    right, left = ([float(x) for x in row] for row in rows)
    return right, left
