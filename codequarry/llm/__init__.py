"""Training-data operators: text, URL and vector steps of a corpus pipeline.

Nothing outside this subpackage imports it.
"""
