"""Configuration: defaults, presets, a TOML file, arguments, each over the one before."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace
from pathlib import Path

from .budget import MODES

MODULES = ("quality", "deep_statistics", "anomaly_detection", "time_series", "text_profile", "target_intelligence", "modeling", "explainability", "segments", "cleaning", "signals")
#: Modules that a mode leaves out, and presets.
MODE_SKIPS = {
    "quick": ("deep_statistics", "anomaly_detection", "time_series", "text_profile", "modeling", "explainability"),
    "standard": ("deep_statistics", "text_profile", "modeling", "explainability"),
    "deep": ("modeling", "explainability"),
    "research": (),
}
PRESETS = {"default": {}, "ci": {"mode": "quick"}, "exploration": {"mode": "deep"}, "modeling": {"mode": "research"}, "monitoring": {"mode": "standard", "disabled_modules": ("cleaning",)}}


@dataclass(frozen=True)
class Config:
    mode: str = "standard"
    disabled_modules: tuple[str, ...] = ()
    workers: int = 2
    target: str | None = None

    def enabled(self, module: str) -> bool:
        return module not in self.disabled_modules and module not in MODE_SKIPS[self.mode]


def resolve_config(preset: str | None = None, path: str | None = None, **given) -> Config:
    values: dict = {}
    if preset is not None:
        if preset not in PRESETS:
            raise ValueError(f"a preset is one of {', '.join(PRESETS)}")
        values |= PRESETS[preset]
    if path is not None:
        values |= tomllib.loads(Path(path).read_text()).get("tidewatch", {})
    values |= {k: v for k, v in given.items() if v is not None}
    values["disabled_modules"] = tuple(values.get("disabled_modules", ()))
    unknown = set(values) - {"mode", "disabled_modules", "workers", "target"}
    if unknown or values.get("mode", "standard") not in MODES or set(values["disabled_modules"]) - set(MODULES):
        raise ValueError(f"unknown settings: {unknown or values}")
    return replace(Config(), **values)
