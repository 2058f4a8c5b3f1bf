"""Dataflow operators: cohort, notes, extraction, harmonisation, de-identification, tables, metadata, privacy."""
