"""Training-data operators: one module for each, their queries and SQL in ``registry``."""
