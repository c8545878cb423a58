"""Settings, with defaults and an optional YAML file over them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

# Which suffixes are read as what, and what a scan leaves out.
CODE = {".cs": "csharp", ".py": "python", ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".html": "html", ".htm": "html"}
STRUCTURED = (".json", ".xml", ".csproj", ".props", ".config")
DOCUMENT = (".md", ".txt", ".rst", ".pdf", ".docx", ".pptx", ".epub", ".ipynb", ".csv", ".png", ".jpg", ".jpeg", ".xlsx")
EXCLUDED_SUFFIXES = (".bin", ".exe", ".dll", ".obj", ".pdb")
EXCLUDED_DIRS = (
    "node_modules", ".git", ".svn", ".hg", "bin", "obj", "dist", "build", ".vs", ".idea", "__pycache__", ".mypy_cache",
    ".pytest_cache", "venv", ".venv", ".github", ".vscode", "Debug", "Release", ".grepai",
)
INDEXERS = {"dotnet": "scip-dotnet", "python": "scip-python", "java": "scip-java", "typescript": "scip-typescript", "javascript": "scip-typescript"}
MAX_FILE_BYTES = 10 * 1024 * 1024
TOP_K, MOST_K = 6, 20


# Defaults of the settings below that must match: sizes, ratio, thresholds, server and model.
@dataclass
class Settings:
    """All knobs. A key of the YAML file overrides its default; a bad file or key leaves the default."""

    code_extensions: dict[str, str] = field(default_factory=lambda: dict(CODE))
    structured_extensions: tuple[str, ...] = STRUCTURED
    document_extensions: tuple[str, ...] = DOCUMENT
    exclude_extensions: tuple[str, ...] = EXCLUDED_SUFFIXES
    exclude_dirs: tuple[str, ...] = EXCLUDED_DIRS
    scip_indexers: dict[str, str] = field(default_factory=lambda: dict(INDEXERS))
    persist_dir: str = "data/tessera"
    #: "hashed" (offline) or "server"; a YAML file that names a server or its model means "server".
    embedder: str = "hashed"
    ollama_base_url: str = "http://localhost:11434"
    ollama_embedding_model: str = "nomic-embed-text"
    chunk_size: int = 512
    chunk_overlap_ratio: float = 0.2
    ingest_batch_size: int = 100
    ingest_large_dir_threshold: int = 10_000
    embed_batch_size: int = 50
    embed_builder_debug: bool = False
    embed_builder_debug_output_dir: str = "logs/EmbedBuilder"
    log_level: str = "INFO"
    log_levels: dict[str, str] = field(default_factory=dict)

    @property
    def chunk_overlap(self) -> int:
        return round(self.chunk_size * self.chunk_overlap_ratio)

    @property
    def supported(self) -> set[str]:
        return {*self.code_extensions, *self.structured_extensions, *self.document_extensions}


def load(path: str | None = None) -> Settings:
    settings = Settings()
    if path is None:
        return settings
    try:
        import yaml

        found = yaml.safe_load(Path(path).read_text("utf-8")) or {}
    except Exception:  # an unreadable file means the defaults, as documented
        return settings
    if not isinstance(found, dict):
        return settings
    # keys of other stores and loggers: *_persist_dir names the folder, *_log_level the level of a logger
    for key, value in found.items():
        if isinstance(key, str) and isinstance(value, str):
            if key.endswith("_persist_dir"):
                found = {"persist_dir": value, **found}
            elif key.endswith("_log_level"):
                settings.log_levels[key.removesuffix("_log_level")] = value
    if {"ollama_base_url", "ollama_embedding_model"} & set(found):
        found = {"embedder": "server", **found}
    for f in fields(Settings):
        value = found.get(f.name)
        if value is None:
            continue
        old = getattr(settings, f.name)
        if isinstance(old, tuple) and isinstance(value, list):
            setattr(settings, f.name, tuple(map(str, value)))
        elif isinstance(value, type(old)) or isinstance(old, float) and isinstance(value, int):
            setattr(settings, f.name, value)
    return settings
