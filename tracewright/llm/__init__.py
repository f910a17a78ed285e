"""Training-corpus operators: one module per operator, queries and SQL in ``registry``."""
