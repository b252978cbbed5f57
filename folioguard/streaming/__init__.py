"""Row-wise checks on streams."""
