"""Readers and writers: CSV/JSON/text scans, artefact sinks."""
