"""Sources and sinks: PNG codec, frames, OME documents, tile files."""
