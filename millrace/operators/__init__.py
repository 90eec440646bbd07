"""Operators: each module exposes functions DataFrame -> DataFrame."""
