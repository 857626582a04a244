"""Corpus operators for language-model training data.  Nothing outside imports this."""
