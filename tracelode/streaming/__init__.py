"""Structured Streaming jobs over event folders.

Each function takes a streaming DataFrame (or a folder) and returns a streaming DataFrame; ``drain`` runs
one to the end of what is there (``availableNow``) with a checkpoint in the shared folder, and returns the sink's table.
Timestamps must be TIMESTAMP, because a watermark refuses TIMESTAMP_NTZ.
"""
