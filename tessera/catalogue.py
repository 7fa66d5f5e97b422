"""The record-linkage queries by name, and the SQL that gives the same rows."""

from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
