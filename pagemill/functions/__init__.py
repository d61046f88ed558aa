"""Column functions: built-in expressions only, so Catalyst sees through them."""
