"""Event-time operators in batch form and as Structured Streaming queries."""
