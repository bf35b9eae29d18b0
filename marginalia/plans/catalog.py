"""All queries of the engine: name to (function of spark and folder, SQL or None)."""

from __future__ import annotations

from marginalia.plans import catalog_changes, catalog_index, catalog_pages, catalog_rest, catalog_text

CATALOG: dict[str, tuple] = {**catalog_text.CATALOG, **catalog_pages.CATALOG, **catalog_changes.CATALOG, **catalog_rest.CATALOG, **catalog_index.CATALOG}
