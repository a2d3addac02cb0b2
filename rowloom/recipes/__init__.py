from .actions import Action, Cast, Comparison, Delete, Fill, Filter, FormatTimestamp, Operator, Rename, where
from .recipe import Recipe, dumps, load, loads, save

__all__ = [
    "Action", "Cast", "Comparison", "Delete", "Fill", "Filter", "FormatTimestamp", "Operator", "Recipe", "Rename",
    "dumps", "load", "loads", "save", "where",
]
