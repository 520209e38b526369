"""Training-data operators: each module implements one operator and nothing outside this subpackage imports it."""
