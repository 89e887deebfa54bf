"""Readers and writers for sessions, annotations, logs and reports."""
