"""Settings: the nearest file upwards, then the environment; the file wins."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass
class Settings:
    """Embedding service, chunk sizes and switches; sizes are positive."""

    base_url: str = ""
    model: str = ""
    api_key: str = ""
    chunk_size: int = 4096
    chunk_overlap: int = 512
    max_chunks: int = 12
    hyde: bool = False
    probe: bool = True


def load(start: str, name: str = "sparksift.config.json", prefix: str = "SPARKSIFT_") -> Settings:
    out = Settings()
    for f in fields(Settings):
        if (v := os.environ.get(prefix + f.name.upper())) is not None:
            setattr(out, f.name, v.lower() in ("1", "true", "yes") if isinstance(getattr(out, f.name), bool) else int(v) if isinstance(getattr(out, f.name), int) else v)
    at = Path(start).resolve()
    found = next((p / name for p in (at, *at.parents) if (p / name).is_file()), None)
    for k, v in (json.loads(found.read_text()) if found else {}).items():
        if k in {f.name for f in fields(Settings)} and type(v) is type(getattr(out, k)):
            setattr(out, k, v)
    for f in fields(Settings):
        v = getattr(out, f.name)
        if isinstance(v, int) and not isinstance(v, bool) and v <= 0:
            raise ValueError(f"{f.name} must be positive")
    return out
