"""Text-signal and panel analytics on Spark DataFrames.

Documents are scored against word lexicons, long transcripts are cut into sections, entity-by-quarter
panels get gap-guarded outcomes, and rankings, correlations and fixed-effects fits are computed over them.
The subpackage ``llm`` holds the training-data operators; nothing outside it imports it.
"""

__version__ = "0.1.0"
