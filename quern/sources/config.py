"""Configuration: YAML sections over defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Config:
    chunk_size: int = 300
    overlap: int = 50
    embedder: str = "hash"
    dimension: int = 384
    top_k: int = 3
    similarity_threshold: float = 0.0
    max_context: int = 4000
    provider: str = "extractive"
    provider_settings: dict = field(default_factory=dict)
    max_tokens: int = 1000
    temperature: float = 0.7
    index_path: str = "memory_index"


def load_config(path: str | Path | None = None) -> Config:
    """The sections chunking, embedding, retrieval, context, llm and storage of a YAML file; what is missing takes its default."""
    if path is None:
        return Config()
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    part = lambda name: raw.get(name) or {}
    d, llm = Config(), part("llm")
    provider = str(llm.get("provider", d.provider)).lower()
    return Config(
        chunk_size=part("chunking").get("chunk_size", d.chunk_size),
        overlap=part("chunking").get("overlap", d.overlap),
        embedder=part("embedding").get("model_name", d.embedder),
        dimension=part("embedding").get("dimension", d.dimension),
        top_k=part("retrieval").get("top_k", d.top_k),
        similarity_threshold=part("retrieval").get("similarity_threshold", d.similarity_threshold),
        max_context=part("context").get("max_context_length", d.max_context),
        provider=provider,
        provider_settings=dict(llm.get(provider) or {}),
        max_tokens=llm.get("max_tokens", d.max_tokens),
        temperature=llm.get("temperature", d.temperature),
        index_path=part("storage").get("index_path", d.index_path),
    )
