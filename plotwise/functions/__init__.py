"""Column functions: text keys and plane and sphere geometry, as built-in expressions."""
