"""Named queries over the driver tables, each with the SQL that checks it where SQL can."""

from cindergrid.catalog import collection, evaluation, exploration, features, learning, sequences, storage
from cindergrid.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "collection", "evaluation", "exploration", "features", "learning",
           "sequences", "storage"]
