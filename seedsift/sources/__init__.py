"""Corpus, seed list, index tables, stored models and reports."""
