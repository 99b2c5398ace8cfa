"""Training-data operators: one module an operator, and their queries in ``registry``."""
