"""Operators for large training corpora, their queries and the pipeline's stages."""
