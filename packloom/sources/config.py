"""Settings: an explicit file, else ``packloom.toml`` in the working folder, else defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields

# Fixed values of the asset pipeline.
LARGE_FILE = 256 << 20
CDC_MIN, CDC_AVG, CDC_MAX = 16 << 10, 64 << 10, 256 << 10
DICT_SAMPLE_BYTES, DICT_MAX_SAMPLES, DICT_MIN_SAMPLES, DICT_BYTES = 8 << 10, 100, 5, 112_640
PATTERN_SCAN_BYTES, PATTERN_FILES, PATTERNS_KEPT = 64 << 10, 2_000, 4_096
PATCH_LEVEL = 3
BOMB_BYTES = 8 << 30


@dataclass(frozen=True)
class Settings:
    """Compression settings; None in a file means the default."""

    default_level: int = 3
    texture_level: int = 9
    audio_level: int = 1
    mesh_delta: bool = True
    pattern_window: int = 64
    pattern_min_frequency: int = 2
    similarity_window: int = 4_096

    @property
    def levels(self) -> dict[str, int]:
        return {"Texture": self.texture_level, "Audio": self.audio_level}


def load(path: str | None = None) -> Settings:
    """A missing explicit file and a malformed one are errors; a missing default file is not."""
    if path is None:
        path = "packloom.toml"
        if not os.path.exists(path):
            return Settings()
    with open(path, "rb") as file:
        found = tomllib.load(file).get("compression", {})
    names = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in found.items() if k in names and v is not None})
