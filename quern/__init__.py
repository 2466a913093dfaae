"""quern: a PySpark-native retrieval-memory engine (chunk, embed, search, pack, generate, score)."""

__version__ = "0.1.0"
