"""Episodes from streams of events."""
