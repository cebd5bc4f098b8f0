"""Training-data operators: ten of them, one module each, and their registered queries."""
