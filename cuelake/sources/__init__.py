"""Readers and writers: SRT, WAV, timeline and checkpoint files, HTML index."""
