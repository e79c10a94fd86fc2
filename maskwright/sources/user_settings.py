"""Keywords that a user keeps: JSON in the user's folder, defaults where it is missing or damaged."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace

from ..config import Settings


@dataclass(frozen=True)
class UserSettings:
    theme_name: str = "dark"
    custom_base_color: str | None = None
    keywords: list[str] = field(default_factory=list)


def default_path() -> str:
    return os.path.join(os.environ.get("APPDATA") or os.path.expanduser("~"), ".maskwright", "settings.json")


def load(path: str | None = None) -> UserSettings:
    try:
        with open(path or default_path(), encoding="utf-8") as file:
            kept = json.load(file)
        return UserSettings(**{k: kept[k] for k in UserSettings.__dataclass_fields__ if k in kept})
    except (OSError, ValueError, TypeError):
        return UserSettings()


def save(settings: UserSettings, path: str | None = None) -> None:
    path = path or default_path()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(asdict(settings), file, indent=2)


def with_keywords(settings: Settings, user: UserSettings) -> Settings:
    """Settings in which each keyword is a known ``org``."""
    return replace(settings, known_terms={**settings.known_terms, **{k: "org" for k in user.keywords}})
