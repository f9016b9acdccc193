"""Projects that arrive as a stream."""
