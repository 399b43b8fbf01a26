"""Prompt-injection scanning, intent scoring and prompt assembly as PySpark jobs."""

__version__ = "0.1.0"
