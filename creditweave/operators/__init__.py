"""The engine's relational and domain operators."""
