"""Landed payloads and their parsers; importing the package registers all formats."""

from calibra.sources import feeds, generic  # noqa: F401
