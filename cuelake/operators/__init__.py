"""Operators on cues, timelines, fragments, audio and refinement state."""
