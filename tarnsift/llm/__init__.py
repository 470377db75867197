"""Training-data operators. Nothing else in tarnsift imports this subpackage."""
