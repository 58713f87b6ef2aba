"""Streams of bank credits."""
