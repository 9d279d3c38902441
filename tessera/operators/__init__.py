"""Row-wise, grouped and windowed operators over pixel relations."""
