"""Telling a caller how far a long operation is. Everything is called on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol


class Progress(Protocol):
    def begin(self, phase: str, total: int | None) -> None: ...

    def step(self, done: int) -> None: ...

    def end(self) -> None: ...


class Silent:
    """No news."""

    def begin(self, phase: str, total: int | None) -> None:
        pass

    def step(self, done: int) -> None:
        pass

    def end(self) -> None:
        pass


@contextmanager
def phase(progress: Progress | None, name: str, total: int | None = None) -> Iterator[Progress]:
    """A phase that ends however it ends."""
    p = progress or Silent()
    p.begin(name, total)
    try:
        yield p
    finally:
        p.end()
