"""Structured Streaming forms of the line rules and of the login correlation."""
