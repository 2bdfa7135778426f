"""Settings of the retrieval engine, and the user's file of them."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class SearchConfig:
    first_k: int = 600  # candidates of the first match
    expanded_k: int = 900  # candidates of the expanded match
    rerank_k: int = 28  # candidates that are rescored and fused, or as many as are asked for
    final_k: int = 20
    k1: float = 1.2
    b: float = 0.75
    rrf_k: int = 60
    jaccard: float = 0.83
    mmr_lambda: float = 0.7
    feedback_docs: int = 10
    feedback_terms: int = 20
    max_terms: int = 16
    snippet_chars: int = 280
    words_per_span: int = 220
    stride: int = 200
    max_file_size: int = 2 * 1024 * 1024

    @classmethod
    def from_env(cls, prefix: str = "TEXTLOOM_") -> SearchConfig:
        """Defaults, and what the environment sets, such as TEXTLOOM_FINAL_K."""
        return cls(**{f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ})


DEFAULTS = {"index": "", "exclude": [], "include": [], "watch": [], "search": asdict(SearchConfig())}


def config_path() -> Path:
    return Path(os.environ.get("TEXTLOOM_CONFIG", Path.home() / ".textloom" / "config.json"))


def load_config(path: Path | None = None) -> dict:
    """The user's settings over the defaults; a missing or broken file counts as empty."""
    try:
        own = json.loads((path or config_path()).read_text())
    except (OSError, ValueError):
        own = {}
    merged = DEFAULTS | {k: v for k, v in own.items() if k in DEFAULTS}
    return merged | {"search": DEFAULTS["search"] | own.get("search", {})}


def save_config(settings: dict, path: Path | None = None) -> None:
    path = path or config_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(".new")
    new.write_text(json.dumps(settings, indent=2, sort_keys=True) + "\n")
    new.replace(path)
