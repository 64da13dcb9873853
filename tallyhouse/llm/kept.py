"""Results that a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
from collections.abc import Callable


class Kept:
    """Calls ``make`` once a process for each of its latest ``most`` argument tuples.

    Functions of this package travel to workers by value and get new globals in every task, so what is kept lies in
    ``sys``, which every task of a worker shares; the object itself travels empty.
    """

    def __init__(self, make: Callable, most: int = 8) -> None:
        self.make, self.most = make, most

    def __call__(self, *args):
        store = sys.__dict__.setdefault("_tallyhouse_kept", {}).setdefault(f"{self.make.__module__}.{self.make.__qualname__}", {})
        if args not in store:
            while len(store) >= self.most:
                store.pop(next(iter(store)))
            store[args] = self.make(*args)
        return store[args]


def kept(most: int = 8) -> Callable[[Callable], Kept]:
    return lambda make: Kept(make, most)
