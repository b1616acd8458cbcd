"""Readers and writers of claims, feature tables, policy documents and reports."""
