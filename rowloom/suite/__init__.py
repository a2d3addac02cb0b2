from . import files, filters, json_cells, recipes, schemas, streams, views
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "files", "filters", "json_cells", "recipes", "schemas", "streams", "views"]
