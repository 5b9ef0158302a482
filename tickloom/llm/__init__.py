"""Training-data operators: one module for each. Nothing outside this subpackage imports it."""
