"""Expression languages: text to trees, trees to columns."""
