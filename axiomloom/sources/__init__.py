"""Readers, writers and ontology exports."""
