"""Event-time measures on streams."""
