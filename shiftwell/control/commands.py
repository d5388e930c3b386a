"""Commands for a running migration, as text lines: name, name=value, or name=? to ask."""

from __future__ import annotations

from ..spec import Options

_NUMBERS = {"chunk-size": "chunk_size", "dml-batch-size": "dml_batch_size", "nice-ratio": "nice_ratio", "max-lag-millis": "max_lag_millis"}
_LOADS = {"max-load": "max_load", "critical-load": "critical_load"}


def parse_load(text: str) -> dict[str, int]:
    """'k=v,k=v' as numbers."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        k, sep, v = part.partition("=")
        if not sep or not v.strip().isdigit():
            raise ValueError(f"not a load: {part}")
        out[k.strip()] = int(v)
    return out


class Commands:
    """Reads and changes the options of a migration."""

    def __init__(self, options: Options, status=lambda: {}, on_panic=None):
        self.options, self.status, self.on_panic = options, status, on_panic
        self.throttled, self.postponed, self.throttle_query, self.throttle_http, self.replicas = False, False, "", "", ""

    def __call__(self, line: str) -> str:
        name, sep, value = (x.strip() for x in line.partition("="))
        ask = value == "?" or (not sep and (name in _NUMBERS or name in _LOADS))
        if name in ("help", ""):
            return "status sup coordinates applier inspector chunk-size dml-batch-size nice-ratio max-lag-millis max-load critical-load throttle no-throttle throttle-query throttle-http throttle-control-replicas postpone unpostpone panic"
        if name in ("status", "info", "sup", "coordinates", "applier", "inspector"):
            facts = self.status()
            return str(facts.get(name, facts) if name not in ("status", "info") else facts)
        if name in _NUMBERS:
            at = _NUMBERS[name]
            if not ask:
                setattr(self.options, at, type(getattr(self.options, at))(float(value)))
                self.options.__post_init__()
            return str(getattr(self.options, at))
        if name in _LOADS:
            if not ask:
                setattr(self.options, _LOADS[name], parse_load(value))
            return ",".join(f"{k}={v}" for k, v in sorted(getattr(self.options, _LOADS[name]).items()))
        if name in ("throttle-query", "throttle-http", "throttle-control-replicas"):
            at = {"throttle-query": "throttle_query", "throttle-http": "throttle_http", "throttle-control-replicas": "replicas"}[name]
            if not ask:
                setattr(self, at, value)
            return getattr(self, at)
        if name in ("throttle", "pause", "suspend"):
            self.throttled = True
        elif name in ("no-throttle", "unthrottle", "resume", "continue"):
            self.throttled = False
        elif name == "postpone":
            self.postponed = True
        elif name in ("unpostpone", "no-postpone", "cut-over"):
            self.postponed = False
        elif name == "panic":
            if self.on_panic:
                self.on_panic()
            raise SystemExit("commanded to panic")
        else:
            raise ValueError(f"no such command: {name}")
        return "ok"
