"""Imports every query module, filling the registry."""

from checks import fixtures  # noqa: F401
from checks import q_codes, q_collections, q_convert, q_functions, q_pools, q_sampling, q_search, q_sources, q_stats, q_streams  # noqa: F401
