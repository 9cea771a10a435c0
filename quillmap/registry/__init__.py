"""Named queries over the test tables, each with an independent SQL check where SQL can say it."""

from quillmap.registry import corpus, landscape, network, relations, search  # noqa: F401
from quillmap.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
