"""Options from an ini file: sections client and osc, values ${NAME} from the environment."""

from __future__ import annotations

import configparser
import os
import re


def read_config(path: str, environ: dict[str, str] | None = None) -> dict[str, dict[str, str]]:
    parser = configparser.ConfigParser(interpolation=None, allow_no_value=True)
    if not parser.read(path):
        raise FileNotFoundError(path)
    env = os.environ if environ is None else environ

    def value(v: str | None) -> str:
        m = re.fullmatch(r"\$\{(\w+)\}", v or "")
        return env.get(m[1], "") if m else v or ""

    return {s: {k: value(v) for k, v in parser.items(s)} for s in parser.sections()}
