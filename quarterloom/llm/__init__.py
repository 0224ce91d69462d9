"""Operators that ready transcripts and documents for training. Nothing outside this folder imports it."""
