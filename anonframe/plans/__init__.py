"""Plans: class maps over keys."""
