"""Sources and sinks of entities."""
