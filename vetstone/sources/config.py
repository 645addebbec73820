"""The configuration file: TOML, found upward of the scanned root; flags beat it, and it beats the defaults."""

from __future__ import annotations

import tomllib
from pathlib import Path

NAME = "vetstone.toml"
#: Known keys and their defaults.
DEFAULTS: dict = {"layers": ["code", "dependencies", "infrastructure"], "exclude": [], "format": "table", "min_severity": None, "fail_on": None, "max_feed_age": "7d", "offline": False, "packs": {}, "suppressions": []}
SUPPRESSION = {"finding_id", "rule_id", "path", "reason", "expires"}


def discover(root: str) -> Path | None:
    at = Path(root).resolve()
    return next((d / NAME for d in (at, *at.parents) if (d / NAME).is_file()), None)


def parse(text: str) -> dict:
    """The file's settings; an unknown key or an incomplete suppression is an error."""
    found = tomllib.loads(text)
    if unknown := found.keys() - DEFAULTS.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for s in found.get("suppressions", []):
        if s.keys() - SUPPRESSION or not {"reason", "expires"} <= s.keys():
            raise ValueError(f"not a suppression (reason and expires are needed): {s}")
    return found


def load(root: str, explicit: str | None = None, **flags) -> dict:
    """The settings in effect; a flag that is None isn't set."""
    at = Path(explicit) if explicit else discover(root)
    return DEFAULTS | (parse(at.read_text()) if at else {}) | {k: v for k, v in flags.items() if v is not None}
