"""Fixed word lists (one word per line)."""
