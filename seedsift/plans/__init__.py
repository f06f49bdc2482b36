"""Distributed building blocks and the jobs composed from the operators."""
