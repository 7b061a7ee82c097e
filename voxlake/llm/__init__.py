"""Training-data operators: ten corpus operators and the queries that apply them."""
