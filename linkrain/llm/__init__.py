"""Training-data pipeline operators: ten document and vector operators, each in a module of its own."""
