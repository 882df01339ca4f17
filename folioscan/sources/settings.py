"""Settings in a JSON file."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from folioscan import schema as S
from folioscan.sources.extractors import default_registry


def normalize_extension(value: str | None) -> str:
    """An extension with its dot in small letters, from an extension or a path."""
    value = (value or "").strip()
    if "/" in value or "\\" in value:
        name = value.replace("\\", "/").rpartition("/")[2]
        value = name[name.rindex(".") :] if "." in name and not name.endswith(".") else ""
    return "" if not value else (value if value.startswith(".") else "." + value).lower()


def normalize_extensions(values: list[str] | None) -> list[str]:
    """Normalised extensions in order, each once, none empty."""
    return list(dict.fromkeys(e for e in map(normalize_extension, values or []) if e))


def normalize_folder(folder: str) -> str:
    """A folder without separators at its end; a drive keeps one."""
    trimmed = folder.strip().rstrip("/\\")
    if len(trimmed) in (1, 2) and trimmed[:1].isalpha() and trimmed[1:] in ("", ":"):
        return trimmed[0] + ":\\"
    return trimmed or folder.strip()[:1]


def _key(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


@dataclass
class Settings:
    target_folders: list[str] = field(default_factory=list)
    target_extensions: list[str] = field(default_factory=list)
    index_path: str = ""
    last_index_update: str | None = None
    auto_rebuild_interval_minutes: int = 0
    theme_mode: str = "System"

    @classmethod
    def load(cls, path: str) -> Settings:
        """The settings in a file; defaults, with every readable extension, if there
        is none or it can't be read."""
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            out = cls(**{k: found[_key(k)] for k in cls.__dataclass_fields__ if _key(k) in found})
        except (OSError, ValueError, TypeError):
            return cls(target_extensions=default_registry().extensions())
        out.target_extensions = normalize_extensions(out.target_extensions)
        return out

    def save(self, path: str) -> None:
        """Write the settings; the file is replaced in one step."""
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(part := f"{path}.part", "w", encoding="utf-8") as f:
            json.dump({_key(k): v for k, v in asdict(self).items()}, f, ensure_ascii=False, indent=2)
        os.replace(part, path)

    def add_folder(self, folder: str) -> str | None:
        """Add a folder; the reason if it can't be added."""
        folder = folder.strip().rstrip("/\\")
        if not folder:
            return "フォルダパスを入力してください"
        if not os.path.isdir(folder):
            return "フォルダが見つかりません。パスを確認してください。"
        if folder.lower() in (f.rstrip("/\\").lower() for f in self.target_folders):
            return "既に追加されています"
        self.target_folders.append(folder)
        return None

    def add_extension(self, ext: str) -> str | None:
        """Add an extension; the reason if it can't be added."""
        ext = ext.strip()
        ext = ext if not ext or ext.startswith(".") else "." + ext
        if ext and ext.lower() in (e.lower() for e in self.target_extensions):
            return "既に追加されています"
        if ext:
            self.target_extensions.append(ext)
        return None

    def remove_folder(self, folder: str) -> bool:
        """Take a folder out, whatever its case and last separator; whether it was there.
        Its documents leave an index with the next ``purge_unlisted`` or rebuild."""
        kept = [f for f in self.target_folders if f.rstrip("/\\").lower() != folder.strip().rstrip("/\\").lower()]
        found, self.target_folders = len(kept) < len(self.target_folders), kept
        return found

    def remove_extension(self, ext: str) -> bool:
        """Take an extension out, whatever its case; whether it was there."""
        kept = [e for e in self.target_extensions if e.lower() != ext.strip().lower()]
        found, self.target_extensions = len(kept) < len(self.target_extensions), kept
        return found

    def refresh_minutes(self) -> int:
        """The interval of periodic updates, 0 if off."""
        return self.auto_rebuild_interval_minutes if self.auto_rebuild_interval_minutes in S.AUTO_REBUILD_MINUTES else 0
