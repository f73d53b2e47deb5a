"""DataFrame operators of one interval step."""
