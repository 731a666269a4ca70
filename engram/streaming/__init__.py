"""Capture streams: change detection, sessions and sinks."""
