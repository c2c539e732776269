"""Physical side: filter trees as Columns, pages, facets, delta overlays, upserts; DataFrame operations all."""
