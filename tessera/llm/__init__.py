"""Training-data operators: ten corpus operators and the stages built from them."""
