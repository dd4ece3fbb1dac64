"""Sources, the snapshot store and sinks."""
