"""All named queries. Importing this module fills the registry."""

from tessera.plans import catalog_basic, catalog_checks, catalog_mining, catalog_models, catalog_stats  # noqa: F401
from tessera.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
