"""Intermediate tables of the operators here: the library's staged tables."""

from groundloom.sources.staging import drop, folder, new_path
from groundloom.sources.staging import staged as table

__all__ = ["drop", "folder", "new_path", "table"]
