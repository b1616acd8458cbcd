"""Whole runs, composed from sources and operators."""
