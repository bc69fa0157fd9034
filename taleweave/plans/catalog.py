"""All registered queries.  Importing this module registers them."""

from . import catalog_functions, catalog_relational, catalog_search, catalog_story  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
