"""Puts the repository's root on the path, for the tests."""
