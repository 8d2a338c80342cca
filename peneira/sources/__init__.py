"""Source registry, raw message store and table sinks."""
