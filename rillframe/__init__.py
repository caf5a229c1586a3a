"""Ordered analytics on Spark DataFrames."""

from rillframe.ordered import Ordered, in_order
from rillframe.session import session

__all__ = ["Ordered", "in_order", "session"]
