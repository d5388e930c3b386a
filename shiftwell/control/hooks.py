"""Lifecycle hooks: executables named after an event, functions, or several of either."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from pathlib import Path

#: Fixed names of the events.
EVENTS = (
    "startup", "validated", "rowcount-complete", "before-row-copy", "row-copy-complete", "stop-replication", "start-replication", "begin-postponed",
    "before-cut-over", "interactive-command", "success", "failure", "status", "batch-copy-retry",
)


class Hooks:
    """Functions by event, in order; the first error ends the event."""

    def __init__(self) -> None:
        self._by: dict[str, list[Callable[[dict], None]]] = {}

    def on(self, event: str, f: Callable[[dict], None]) -> None:
        if event not in EVENTS:
            raise ValueError(f"no such event: {event}")
        self._by.setdefault(event, []).append(f)

    def fire(self, event: str, **facts) -> None:
        for f in self._by.get(event, []):
            f(facts)


class ExecutableHooks(Hooks):
    """Executables <prefix>-on-<event>* of a folder, in order of name, with the facts as environment variables."""

    def __init__(self, folder: str, prefix: str = "shiftwell"):
        super().__init__()
        self.folder, self.prefix = Path(folder), prefix

    def fire(self, event: str, **facts) -> None:
        for p in sorted(self.folder.glob(f"{self.prefix}-on-{event}*")):
            if os.access(p, os.X_OK):
                env = os.environ | {f"SHIFTWELL_{k.upper()}": str(v) for k, v in facts.items()}
                subprocess.run([str(p)], env=env, check=True)
        super().fire(event, **facts)


class Composite(Hooks):
    def __init__(self, *parts: Hooks):
        super().__init__()
        self.parts = parts

    def fire(self, event: str, **facts) -> None:
        for p in self.parts:
            p.fire(event, **facts)
        super().fire(event, **facts)
