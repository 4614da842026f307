"""Column functions: timecodes, cue text, languages and names."""
