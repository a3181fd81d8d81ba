"""Reading and writing log text and entry tables."""
