"""The operators bound to the driver's tables."""

from .slate import ORACLES, QUERIES  # noqa: I001
from . import slate_fields, slate_images, slate_indexed, slate_more, slate_requests, slate_stored  # noqa: F401  (register their queries)

__all__ = ["ORACLES", "QUERIES"]
