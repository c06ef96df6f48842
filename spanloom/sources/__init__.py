"""Readers, OTLP/JSON converters and export layouts."""
