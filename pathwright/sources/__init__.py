"""Readers and writers: exports, TeX and BibTeX archives, providers and sinks."""
