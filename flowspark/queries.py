"""Registered queries over packets and flows, each with the SQL that gives the same rows."""

from .plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
