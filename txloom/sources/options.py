"""Options of a service: environment before file before defaults, each typed by its default."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

DEFAULTS: dict[str, object] = {
    "storageMode": "realtime",
    "seenThreshold": 3,
    "callback.maxRetries": 5,
    "callback.backoffBaseSec": 30,
    "callback.dedupTtlSec": 86_400,
    "subtree.maxAttempts": 3,
    "work.maxAttempts": 10,
    "registry.recencyDays": 7,
    "api.maxCallbacksPerTxid": 10,
    "api.allowPrivateCallbackIps": False,
}


def load(path: str | None = None, environ: Mapping[str, str] | None = None, prefix: str = "TXLOOM_") -> dict[str, object]:
    """The options: DEFAULTS, then a JSON file of the same (nested) names, then variables like TXLOOM_CALLBACK_MAXRETRIES."""
    out = dict(DEFAULTS)

    def put(name: str, value: object) -> None:
        kind = type(DEFAULTS[name])
        if kind is bool and isinstance(value, str):
            value = value.strip().lower() in ("1", "true", "yes")
        out[name] = kind(value)

    def walk(tree: Mapping, head: str) -> None:
        for k, v in tree.items():
            name = f"{head}{k}"
            if isinstance(v, Mapping):
                walk(v, f"{name}.")
            elif name in DEFAULTS:
                put(name, v)

    if path:
        with open(path) as f:
            walk(json.load(f), "")
    env = os.environ if environ is None else environ
    for name in DEFAULTS:
        if (key := prefix + name.replace(".", "_").upper()) in env:
            put(name, env[key])
    return out
