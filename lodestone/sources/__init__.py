"""Where file tables come from."""
