"""What was worked out before."""

from __future__ import annotations

from collections.abc import Callable


class Kept(dict):
    """What a function of one value gave, by the value; all is forgotten beyond size values. A copy that is sent to
    another process is empty."""

    def __init__(self, fn: Callable | None, size: int):
        self.fn, self.size = fn, size

    def __missing__(self, key):
        return self.keep(key, self.fn(key))

    def keep(self, key, value):
        if len(self) >= self.size:
            self.clear()
        self[key] = value
        return value

    def __reduce__(self):
        return Kept, (self.fn, self.size)
