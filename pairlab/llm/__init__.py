"""Training-data operators: ten large-scale corpus operators and their registered queries."""
