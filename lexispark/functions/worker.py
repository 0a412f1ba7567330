"""Things that a worker process makes once. Functions travel to executors by value and every copy has globals of its own, so
that what they share lives in a module that only exists in memory."""

from __future__ import annotations

import sys
import types


def once(key, make, most: int = 4):
    """make(), remembered under the key; beyond `most` the oldest goes."""
    made = vars(sys.modules.setdefault("_lexispark_made", types.ModuleType("_lexispark_made")))
    held = made.setdefault("held", {})
    if key not in held:
        while len(held) >= most:
            del held[next(iter(held))]
        held[key] = make()
    return held[key]
