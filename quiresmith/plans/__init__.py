"""Registered queries, one module for each area. Importing them registers them."""

from quiresmith.plans import archives, chars, css, jobs, links, manifest, media, naming, platform  # noqa: F401
