"""File, text and bibliography sources and report sinks."""
