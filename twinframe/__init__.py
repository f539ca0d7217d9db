"""Near-duplicate resolution for media catalogues, written as Spark DataFrame jobs."""

from twinframe.config import Settings

__all__ = ["Settings"]
