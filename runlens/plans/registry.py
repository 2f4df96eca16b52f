"""All named queries over the given tables, and their SQL twins."""

from __future__ import annotations

from . import files, reports, streams, texts  # noqa: F401  registers its queries
from .base import QUERIES, SQL  # noqa: F401
