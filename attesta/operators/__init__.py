"""DataFrame operators: typed tables in, tables out; none collects or keeps a session."""
