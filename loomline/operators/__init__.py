"""DataFrame algebra of dependency graphs and run state."""
