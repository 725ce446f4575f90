"""The query catalogue: all queries are registered when this package is imported."""

from ledgerline.plans import catalogue, stored

__all__ = ["catalogue", "stored"]
