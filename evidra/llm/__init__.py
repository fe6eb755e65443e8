"""Training-data operators: one module per operator, nothing outside this package imports it."""
