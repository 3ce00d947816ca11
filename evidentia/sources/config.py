"""Run-time settings: the flat text form and the closed JSON form."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

#: Values that a run must have (fixed values), and what may be set beside them and the two roots.
FROZEN = {"backbone": "microsoft/deberta-v3-base", "max_units": 24, "max_length": 256, "pooling": "max", "fake_label": 0, "real_label": 1, "top_k": 5}
OPTIONAL = {"profile": "mock", "implementation": "deterministic_mock"}
ROOTS = ("cache_root", "output_root")


def scalar(text: str) -> bool | int | str:
    t = text.strip()
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    try:
        return int(t)
    except ValueError:
        return t.strip("'\"")


def flat(text: str) -> dict[str, Any]:
    """`key: value` lines; blank ones and # comments are skipped."""
    out: dict[str, Any] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            key, sep, value = line.partition(":")
            if not sep:
                raise ValueError(f"not a setting: {line!r}")
            out[key.strip()] = scalar(value)
    return out


@dataclass(frozen=True)
class RunSettings:
    """Settings of a run, with the frozen ones checked and the roots absolute and distinct; no others."""

    values: dict[str, Any]

    def __post_init__(self) -> None:
        if bad := sorted(set(self.values) - {*FROZEN, *OPTIONAL, *ROOTS}):
            raise ValueError(f"unknown settings: {bad}")
        full = FROZEN | OPTIONAL | self.values
        for key, want in FROZEN.items():
            if full[key] != want or type(full[key]) is not type(want):
                raise ValueError(f"{key} must be {want!r}")
        full |= {k: str(Path(str(full[k])).resolve()) for k in ROOTS if k in full}
        if all(k in full for k in ROOTS) and full[ROOTS[0]] == full[ROOTS[1]]:
            raise ValueError("the roots must be distinct")
        object.__setattr__(self, "values", full)

    @classmethod
    def from_file(cls, path: str) -> RunSettings:
        """Settings of a flat file that names both roots; relative ones start at the folder above the file's."""
        at = Path(path).resolve()
        values = flat(at.read_text(encoding="utf-8"))
        if bad := [k for k in ROOTS if k not in values]:
            raise ValueError(f"missing settings: {bad}")
        return cls(values | {k: at.parent.parent / str(values[k]) for k in ROOTS})


def closed(payload: Any, sections: dict[str, set[str]]) -> dict[str, dict[str, Any]]:
    """payload's sections, each with exactly its keys; timeouts positive, strings not blank."""
    if not isinstance(payload, dict):
        raise TypeError("settings must be an object")
    if bad := sorted(set(payload) ^ set(sections)):
        raise ValueError(f"unknown or missing sections: {bad}")
    for name, keys in sections.items():
        section = payload[name]
        if not isinstance(section, dict):
            raise TypeError(f"{name} must be an object")
        if bad := sorted(set(section) ^ keys):
            raise ValueError(f"{name}: unknown or missing keys: {bad}")
        for k, v in section.items():
            if isinstance(v, str) and not v.strip():
                raise ValueError(f"{name}.{k} is blank")
            if k.endswith("timeout_seconds") and (isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 < v < float("inf")):
                raise ValueError(f"{name}.{k} must be a positive number")
    return payload

