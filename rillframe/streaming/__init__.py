"""Event-time windows, batch and streaming, and stateful operators on streams."""
