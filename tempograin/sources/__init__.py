"""Readers and writers for the file layouts of a measurement study."""
