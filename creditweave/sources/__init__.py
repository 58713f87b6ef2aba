"""Where books, statements and advice come from."""
