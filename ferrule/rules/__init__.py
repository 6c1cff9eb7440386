"""Rules."""
