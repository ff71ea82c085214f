"""Roll-ups that hold as streams: those whose parts can be merged."""
