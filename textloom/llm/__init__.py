"""Training-data operators. Self-contained: nothing outside this folder imports it."""
