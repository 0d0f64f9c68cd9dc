"""Imports the modules that register queries."""

from . import (  # noqa: F401
    catalog_evidence,
    catalog_finance,
    catalog_layers,
    catalog_matching,
    catalog_records,
    catalog_scoring,
    catalog_services,
    catalog_sources,
    catalog_text,
)
