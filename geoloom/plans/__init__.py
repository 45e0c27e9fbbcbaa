"""Guarded SQL, results, scenes and the named reports."""
