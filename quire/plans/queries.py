"""All queries of the reference's operators."""

from . import files, objects, order, pages, reader, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
