"""Training-data operators: the ten corpus operations, their queries and their SQL."""
