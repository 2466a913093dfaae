"""Logging to the console and a file a day."""

from __future__ import annotations

import logging
from datetime import date
from pathlib import Path


def system_logger(folder: str = "logs", name: str = "quern") -> logging.Logger:
    logger = logging.getLogger(name)
    if not logger.handlers:
        logger.setLevel(logging.INFO)
        Path(folder).mkdir(parents=True, exist_ok=True)
        for handler in (logging.StreamHandler(), logging.FileHandler(Path(folder) / f"system_{date.today():%Y%m%d}.log")):
            handler.setFormatter(logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s"))
            logger.addHandler(handler)
    return logger


def operation(name: str, **values) -> str:
    """The line of an operation and its values."""
    return f"Operation: {name} | {' | '.join(f'{k}={v}' for k, v in values.items())}"
