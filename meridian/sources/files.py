"""Project folders: settings, profiles with environment values, and model files that are read and written back."""

from __future__ import annotations

import copy
import os
import re
from collections.abc import Callable
from pathlib import Path

import yaml

from ..errors import ProjectError

DEFAULTS = {"locale": "en_US", "currency": "USD", "tables_path": "tables", "metrics_path": "metrics", "unions_path": "unions.yml", "profiles_path": "profiles.yml"}
_VARIABLE = re.compile(r"\{\{\s*env\.(\w+)\s*\}\}")


def filled(text: str, ask: Callable[[str], str] | None = None) -> str:
    """Text with {{ env.NAME }} replaced by environment variables; a missing one is asked for, if there is a way to."""

    def value(m: re.Match) -> str:
        if m[1] in os.environ:
            return os.environ[m[1]]
        if ask is None:
            raise ProjectError(f"the environment has no {m[1]}")
        os.environ[m[1]] = ask(m[1])
        return os.environ[m[1]]

    return _VARIABLE.sub(value, text)


def _yaml(path: Path, ask: Callable[[str], str] | None = None):
    return yaml.safe_load(filled(path.read_text(encoding="utf-8"), ask)) or {}


def load_project(path: str | Path, ask: Callable[[str], str] | None = None) -> dict:
    root = Path(path)
    if not root.is_dir():
        raise ProjectError(f"{root} isn't a folder")
    if not (root / "project.yml").is_file():
        raise ProjectError(f"{root} has no project.yml")
    settings = DEFAULTS | _yaml(root / "project.yml", ask)
    if "name" not in settings:
        raise ProjectError("project.yml needs a name")
    return settings | {"root": root}


def load_profile(settings: dict, profile: str | None = None, ask: Callable[[str], str] | None = None) -> dict:
    path = settings["root"] / settings["profiles_path"]
    if not path.exists():
        raise ProjectError(f"{path} is missing")
    data = _yaml(path, ask)
    name = profile or data.get("default_profile")
    if name not in (data.get("profiles") or {}):
        raise ProjectError(f"there is no profile {name}")
    return data["profiles"][name]


class ModelFiles:
    """A model as files: one for each table and metric, named by its id, in any subfolder, and one for all unions."""

    def __init__(self, settings: dict):
        self.settings, self.root = settings, settings["root"]
        self.places: dict[tuple[str, str], Path] = {}
        self.stored: dict = {}
        self.data: dict = {}

    @classmethod
    def read(cls, settings: dict) -> ModelFiles:
        made = cls(settings)
        data = {k: settings[k] for k in ("name", "description", "locale", "currency", "theme") if k in settings}
        for kind in ("tables", "metrics"):
            data[kind] = {}
            folder = made.root / settings[f"{kind}_path"]
            for path in sorted([*folder.rglob("*.yml"), *folder.rglob("*.yaml")]):
                if path.stem in data[kind]:
                    raise ProjectError(f"{path} and {made.places[kind, path.stem]} have the same name")
                data[kind][path.stem] = _yaml(path)
                made.places[kind, path.stem] = path
        unions = made.root / settings["unions_path"]
        data["unions"] = _yaml(unions) if unions.exists() else {}
        made.data, made.stored = data, copy.deepcopy(data)
        return made

    def model(self) -> dict:
        return copy.deepcopy(self.data)

    def changed(self, data: dict) -> None:
        self.data = copy.deepcopy(data)

    def write(self) -> list[Path]:
        """Write what differs from what was read or written last; files whose entry is gone are removed."""
        touched = []
        for kind in ("tables", "metrics"):
            for key, value in self.data.get(kind, {}).items():
                if self.stored.get(kind, {}).get(key) != value:
                    path = self.places.setdefault((kind, key), self.root / self.settings[f"{kind}_path"] / f"{key}.yml")
                    touched.append(_dump(path, value))
            for key in [k for k in self.stored.get(kind, {}) if k not in self.data.get(kind, {})]:
                path = self.places.pop((kind, key))
                path.unlink()
                touched.append(path)
        if self.data.get("unions") != self.stored.get("unions"):
            touched.append(_dump(self.root / self.settings["unions_path"], self.data.get("unions") or {}))
        self.stored = copy.deepcopy(self.data)
        return touched


def _dump(path: Path, value: dict) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(value, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return path


def scaffold(path: str | Path, name: str, backend: str, parameters: dict, locale: str = "en_US", currency: str = "USD") -> Path:
    """An empty project folder; an existing project is left alone."""
    root = Path(path)
    if (root / "project.yml").exists():
        raise ProjectError(f"{root} holds a project already")
    for folder in ("tables", "metrics"):
        (root / folder).mkdir(parents=True, exist_ok=True)
    _dump(root / "project.yml", {"name": name, "locale": locale, "currency": currency, **{k: DEFAULTS[k] for k in DEFAULTS if k.endswith("_path")}})
    _dump(root / "profiles.yml", {"default_profile": "default", "profiles": {"default": {"type": backend, "parameters": parameters}}})
    _dump(root / "unions.yml", {})
    return root
