"""DataFrame operators: every function takes frames and returns frames."""
