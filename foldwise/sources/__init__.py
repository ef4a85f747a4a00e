"""Reading with contracts, file integrity, and sinks."""
