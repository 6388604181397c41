"""Filter lists, budgets and their JSON files."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, fields


@dataclass
class ProjectSettings:
    filter_extensions: list[str] = field(default_factory=list)
    filter_folders: list[str] = field(default_factory=list)
    filter_files: list[str] = field(default_factory=list)


@dataclass
class Settings(ProjectSettings):
    memory_bytes: int = 256 * 1024 * 1024
    disk_bytes: int = 1024**3
    pack_gap: float = 8.0
    max_display_lines: int | None = None


def load(path: str, kind=Settings):
    """Settings of a file; defaults for missing or unreadable files and for ill-typed fields."""
    out = kind()
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError):
        return out
    for x in fields(kind):
        value, default = raw.get(x.name) if isinstance(raw, dict) else None, getattr(out, x.name)
        if value is not None and (default is None or isinstance(value, type(default)) or isinstance(default, float) and isinstance(value, int)):
            setattr(out, x.name, [str(v).replace("\\", "/").removeprefix("./").strip("/") for v in value] if isinstance(value, list) else value)
    return out


def save(settings, path: str) -> None:
    """Written beside and renamed, so that readers never see half a file."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(asdict(settings), f, indent=2)
        os.replace(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(part)
        raise


def merged(base: ProjectSettings, project: ProjectSettings) -> ProjectSettings:
    """Extensions and folders of both; files of the project."""
    union = lambda a, b: list(dict.fromkeys([*a, *b]))
    return ProjectSettings(union(base.filter_extensions, project.filter_extensions), union(base.filter_folders, project.filter_folders), list(project.filter_files))
