"""Restoring streamed responses."""
