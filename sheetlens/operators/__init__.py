"""DataFrame-in, DataFrame-out analytics operators."""
