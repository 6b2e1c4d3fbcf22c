"""Gridded event and weather analytics on Spark DataFrames."""

from cindergrid.operators.grid import Grid
from cindergrid.session import get_session, shared_folder

__all__ = ["Grid", "get_session", "shared_folder"]
