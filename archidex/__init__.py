"""archidex: catalog analytics over many offline storage volumes, on Spark."""

from archidex.schema import Catalog

__all__ = ["Catalog"]
