"""Plans put together from the operators: one step, a replay."""
