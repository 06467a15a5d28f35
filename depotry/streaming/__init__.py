"""Demand kept up to date from a stream of events."""
