"""Stats of the engine."""
