"""Configuration of models and of collection: read on the driver, merged with defaults, checked."""

from __future__ import annotations

import copy
import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

#: Roles a run can do without; each is on only where the runtime says so.
OPTIONAL_ROLES = {"reranker": "use_reranker"}
# The defaults of a collection, by section.
DEFAULTS: dict[str, dict] = {
    "scheduler": {"daily_count": 80, "time_windows": ["08:00-11:30", "13:00-17:00", "19:00-23:00"], "keywords": ["牙痛", "牙疼", "口腔溃疡"], "rest_between_sessions": [10, 30], "bottom_retry_minutes": [15, 25], "random_skip_chance": 0.1},
    "session_limits": {"per_session_cap": 50, "max_scrolls": 2000, "scroll_stale_limit": 5},
    "collection": {"data_dir": "data", "db_path": "data/archive.db", "detail_scroll_chance": 0.35},
}


@dataclass(frozen=True)
class ModelSpec:
    role: str
    model_id: str
    backend: str = ""
    quantization: str = ""
    device_policy: str = "auto"

    def local_path(self, root: str) -> Path:
        return Path(root) / self.model_id


@dataclass(frozen=True)
class ModelStack:
    specs: dict[str, ModelSpec]
    runtime: dict = field(default_factory=dict)
    paths: dict = field(default_factory=dict)

    def spec(self, role: str) -> ModelSpec:
        if role not in self.specs:
            raise ValueError(f"Unknown model role: {role}")
        return self.specs[role]

    def active(self, optional: bool = False) -> list[str]:
        """The roles a run uses; with ``optional`` those that are switched off as well."""
        return [r for r in self.specs if optional or r not in OPTIONAL_ROLES or self.runtime.get(OPTIONAL_ROLES[r], False)]

    def missing(self, root: str) -> list[str]:
        """Active roles whose folder or configuration file isn't there."""
        return [r for r in self.active() if not (self.spec(r).local_path(root) / "config.json").exists()]

    def manifest(self, root: str) -> dict:
        """What a run's manifest says of its models: those in use, those switched off, the runtime."""
        about = lambda r: {"model_id": self.spec(r).model_id, "backend": self.spec(r).backend, "local_path": str(self.spec(r).local_path(root))}
        on = self.active()
        off = {r: {**about(r), "disabled_by": f"runtime.{OPTIONAL_ROLES[r]}=false"} for r in self.active(optional=True) if r not in on}
        return {"models_root": root, "models": {r: about(r) for r in on}, "active_model_roles": on, "disabled_optional_models": off, "runtime": self.runtime, "paths": self.paths}


def read_settings(path: str) -> dict:
    """A YAML or JSON document as a dict; {} where it is empty."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        got = json.loads(text or "{}")
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs PyYAML") from e
        got = yaml.safe_load(text)
    return got if isinstance(got, dict) else {}


def model_stack(given: Mapping) -> ModelStack:
    """A model stack from a document; every role needs a model_id."""
    known = ("model_id", "backend", "quantization", "device_policy")
    specs = {role: ModelSpec(role=s.get("role", role), **{k: s[k] for k in known if k in s}) for role, s in given.get("model_stack", {}).items()}
    return ModelStack(specs, dict(given.get("runtime", {})), dict(given.get("paths", {})))


def merged(defaults: Mapping[str, dict], given: Mapping) -> dict[str, dict]:
    """Defaults with what is given in known sections and keys; null leaves the default."""
    out = copy.deepcopy(dict(defaults))
    for section, values in given.items():
        if section in out and isinstance(values, Mapping):
            out[section].update({k: v for k, v in values.items() if k in out[section] and v is not None})
    return out


def load_settings(path: str, defaults: Mapping[str, dict] = DEFAULTS) -> dict[str, dict]:
    """Settings from a file over the defaults, checked. A file that isn't there is made from the defaults."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(defaults, f, ensure_ascii=False, indent=2)  # JSON is YAML as well
        return merged(defaults, {})
    got = merged(defaults, read_settings(path))
    if problems := setting_problems(got):
        raise ValueError(f"Bad settings in {path}: {problems}")
    return got


def minutes(window: str) -> tuple[int, int]:
    """The minutes of a day a window 'HH:MM-HH:MM' begins and ends at."""
    m = re.fullmatch(r"(\d\d):(\d\d)-(\d\d):(\d\d)", window)
    if not m:
        raise ValueError(f"Not a time window: {window!r}")
    a, b, c, d = map(int, m.groups())
    if max(a, c) > 23 or max(b, d) > 59 or (a, b) >= (c, d):
        raise ValueError(f"Not a time window: {window!r}")
    return a * 60 + b, c * 60 + d


def setting_problems(s: Mapping[str, dict]) -> list[str]:
    """The settings that break a rule, in order."""

    def window(w: object) -> bool:
        try:
            return bool(minutes(w)) if isinstance(w, str) else False
        except ValueError:
            return False

    def span(v: object) -> bool:
        return isinstance(v, (list, tuple)) and len(v) == 2 and 1 <= v[0] <= v[1]

    at_least_one = lambda v: v >= 1
    chance = lambda v: 0 <= v <= 1
    rules = [
        ("scheduler", "daily_count", at_least_one), ("scheduler", "time_windows", lambda v: bool(v) and all(map(window, v))), ("scheduler", "keywords", bool), ("scheduler", "random_skip_chance", chance), ("scheduler", "rest_between_sessions", span),
        ("scheduler", "bottom_retry_minutes", span), *[("session_limits", k, at_least_one) for k in ("per_session_cap", "max_scrolls", "scroll_stale_limit")], ("collection", "detail_scroll_chance", chance),
    ]
    return [f"{section}.{key}" for section, key, holds in rules if not holds(s[section][key])]
