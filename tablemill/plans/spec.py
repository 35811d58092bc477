"""What a task table is, and configuration."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class TaskSpec:
    """Inputs that a row must have (all or any) and outputs, by alias, that it is to get."""

    inputs: tuple[str, ...]
    outputs: Mapping[str, str] = field(default_factory=dict)
    id_col: str = "id"
    require_all: bool = True
    mode: str = "blank"

    def __post_init__(self):
        if not self.inputs or not self.outputs:
            raise ValueError("a task needs input and output columns")

    @property
    def output_columns(self) -> list[str]:
        return list(self.outputs.values())


#: Defaults that a configuration is merged over, and the names of its keys.
DEFAULTS: dict[str, Any] = {
    "datasource": {"type": "parquet", "require_all_input_fields": True, "concurrency": {"batch_size": 100, "retry_limits": {"api_error": 3, "content_error": 1, "system_error": 2}, "api_pause_duration": 2.0, "api_error_trigger_window": 2.0}},
    "columns_to_extract": [],
    "columns_to_write": {},
    "prompt": {"template": "", "system_prompt": "", "model": "auto", "temperature": 0.7, "required_fields": []},
    "validation": {"enabled": False, "field_rules": {}},
    "routing": {"enabled": False, "field": None, "subtasks": []},
    "token_estimation": {"mode": "io", "sample_size": -1},
}


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """Mappings are merged key by key, everything else (lists too) is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def configured(user: Mapping) -> dict:
    """The configuration over the defaults, checked for what every plan needs."""
    out = deep_merge(DEFAULTS, user)
    for key in ("columns_to_extract", "columns_to_write"):
        if not out[key]:
            raise ValueError(f"{key} is missing")
    return out


def spec_of(config: Mapping) -> TaskSpec:
    source = config["datasource"]
    return TaskSpec(tuple(config["columns_to_extract"]), dict(config["columns_to_write"]), source.get("id_col", "id"), source.get("require_all_input_fields", True), source.get("emptiness", "blank"))


#: Names of token estimation modes.
_MODES = {"input": "in", "input_output": "io", "in": "in", "out": "out", "io": "io"}


def token_mode(mode: str | None) -> str:
    """``in``, ``out`` or ``io``; unknown modes are ``in``."""
    return _MODES.get(str(mode or "").strip().lower(), "in")


def identifier(name: str) -> str:
    """A name that may stand in SQL text, or an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name
