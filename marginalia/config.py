"""Settings of an index: a TOML file with three required keys."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

PATHS = ("vault_path", "vector_path", "keyword_path", "state_path")
#: Names these settings go by in existing files.
ALIASES = {"qdrant_path": "vector_path", "fts_path": "keyword_path", "sync_state_path": "state_path", "collection_name": "collection", "ollama_url": "embedder_url"}
DEFAULT_STATE = "./data/sync_state.sqlite"


@dataclass
class Config:
    vault_path: Path
    vector_path: Path
    keyword_path: Path
    state_path: Path
    collection: str = "chunks"
    embedder_url: str = "http://127.0.0.1:11434"
    embedding_model: str = "nomic-embed-text"
    chunk_size: int = 500
    chunk_overlap: int = 80
    watch_enabled: bool = True
    exclude_globs: list[str] = field(default_factory=list)
    max_context_chunks: int = 8
    redact_patterns: list[str] = field(default_factory=list)

    @property
    def store_path(self) -> Path:
        """Where snapshots lie: chunks, vectors, postings and state share one version, beside the keyword index's name."""
        return self.keyword_path.with_suffix(".tables")


def resolve(value: str, folder: Path) -> Path:
    """$CWD, then variables, then ~; what's still relative goes by the settings file's folder."""
    p = Path(os.path.expanduser(os.path.expandvars(value.replace("$CWD", os.getcwd()))))
    return p if p.is_absolute() else folder / p


def load(path: str | Path) -> Config:
    """KeyError if a required path is missing."""
    source = Path(path)
    given = {ALIASES.get(k, k): v for k, v in tomllib.loads(source.read_text("utf-8")).items()}
    given.setdefault("state_path", DEFAULT_STATE)
    for k in PATHS:
        given[k] = resolve(given[k], source.resolve().parent)
    kinds = {"chunk_size": int, "chunk_overlap": int, "max_context_chunks": int, "watch_enabled": bool, "exclude_globs": list, "redact_patterns": list}
    return Config(**{f.name: kinds.get(f.name, lambda x: x)(given[f.name]) for f in fields(Config) if f.name in given})


TEMPLATE = {
    "vault_path": "$CWD", "qdrant_path": "$CWD/data/vectors", "fts_path": "$CWD/data/keywords", "sync_state_path": "$CWD/data/state", "collection_name": "chunks",
    "ollama_url": Config.embedder_url, "embedding_model": Config.embedding_model, "chunk_size": 500, "chunk_overlap": 80, "watch_enabled": True,
    "exclude_globs": [".git/**", "Templates/**"], "max_context_chunks": 8, "redact_patterns": [],
}


def initialize(path: str | Path, force: bool = False) -> dict:
    """Write a settings file for the working directory; an existing one only with ``force``."""
    import json

    target = Path(path)
    there = target.exists()
    if there and not force:
        raise FileExistsError(f"{target} exists; use --force to overwrite it")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text("".join(f"{k} = {json.dumps(v)}\n" for k, v in TEMPLATE.items()), "utf-8")  # JSON scalars and lists are TOML too
    data = Path.cwd() / "data"
    data.mkdir(parents=True, exist_ok=True)
    return {"initialized": True, "config_path": str(target), "data_dir": str(data), "overwritten": there and force}
