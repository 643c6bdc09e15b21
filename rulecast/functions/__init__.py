"""Building blocks as SQL expression text."""
