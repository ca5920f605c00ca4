"""Reading, windowed extraction and sinks."""
