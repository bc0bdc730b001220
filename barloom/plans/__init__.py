"""Registered queries of the time-series engine, each with the SQL that gives the same rows."""

from barloom.plans.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
