"""Scans of files, archives, annotation exports and labels, and the sinks."""
