"""Operators over tables: detect, resolve, mask, restore, route, measure."""
