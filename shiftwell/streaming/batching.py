"""Batches of a queue of entries, and guards of positions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

#: Positions of a file must fit four bytes (fixed value).
MAX_POSITION = 2**32 - 1


def batches(entries: Iterable[Any], size: int, is_event: Callable[[Any], bool]) -> Iterator[tuple[list, Any | None]]:
    """Up to ``size`` events that follow one another, and the control entry (or None) that ends the batch and runs after it."""
    held: list = []
    for e in entries:
        if is_event(e):
            held.append(e)
            if len(held) == size:
                yield held, None
                held = []
        else:
            yield held, e
            held = []
    if held:
        yield held, None


def check_position(position: int, event_size: int) -> None:
    """Fail where an event's end no longer fits a position."""
    if position + event_size > MAX_POSITION:
        raise OverflowError(f"position {position} + {event_size} exceeds four bytes")


def reconnect(connect: Callable[[Any], Iterator[tuple[Any, Any]]], start: Any, apply: Callable[[Any], None], attempts: int) -> Any:
    """Read (position, event) from ``start`` on; after a failure again from the last complete position, at most ``attempts`` times without progress."""
    at, failures = start, 0
    while True:
        before = at
        try:
            for position, event in connect(at):
                apply(event)
                at = position
            return at
        except ConnectionError:
            failures = 0 if at != before else failures + 1
            if failures >= attempts:
                raise
