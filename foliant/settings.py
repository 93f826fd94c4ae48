"""Settings from a JSON file over the defaults, read again when the file changes; environment variables come last."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    inbox: str = ""
    storage: str = ""
    polling: bool = True
    windows: tuple[tuple[str, str], ...] = ()
    most_live_batches: int = 4
    files_per_batch: int = 10
    backup_days: float = 1.0
    backup_time: str = "02:00"
    backups_kept: int = 7
    trash_days: int = 30
    pause_on_credit_error: bool = True
    target_words: int = 2000


def _value(name: str, raw: object) -> object:
    default = getattr(Settings(), name)
    if isinstance(default, bool):
        return raw if isinstance(raw, bool) else str(raw).lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        pairs = json.loads(raw) if isinstance(raw, str) else raw
        return tuple((str(a), str(b)) for a, b in pairs)
    return type(default)(raw)


def load(path: str | None = None, prefix: str = "FOLIANT_") -> Settings:
    """Unknown keys are left out; a value that does not fit its type is an error that names its key."""
    found: dict[str, object] = {}
    if path and Path(path).exists():
        found |= json.loads(Path(path).read_text() or "{}")
    found |= {f.name: os.environ[prefix + f.name.upper()] for f in fields(Settings) if prefix + f.name.upper() in os.environ}
    out = {}
    for f in fields(Settings):
        if f.name in found:
            try:
                out[f.name] = _value(f.name, found[f.name])
            except (TypeError, ValueError) as x:
                raise ValueError(f"{f.name}: {found[f.name]!r}") from x
    return Settings(**out)


@dataclass
class Watched:
    """The settings of a file; `current` reads it again if it has changed since."""

    path: str
    seen: tuple[int, int] | None = None
    held: Settings = field(default_factory=Settings)

    def current(self) -> Settings:
        p = Path(self.path)
        now = (p.stat().st_mtime_ns, p.stat().st_size) if p.exists() else None
        if self.seen is None or now != self.seen:
            self.held, self.seen = load(self.path), now or (0, 0)
        return self.held
