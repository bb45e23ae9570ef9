"""Readers, bar builders, log decoding and sinks."""
