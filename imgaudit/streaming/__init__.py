"""Incremental scoring and the running scoreboard."""
