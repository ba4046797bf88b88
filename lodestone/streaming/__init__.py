"""Change data capture: mutations, per-volume cursors, and the stream that applies them."""
