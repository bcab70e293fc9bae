"""Queries over the driver's tables."""

from newsloom.plans import catalog, catalog_files, catalog_jobs, catalog_live  # noqa: F401
