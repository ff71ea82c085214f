"""Reading and writing the record tables, and parsing recorded responses."""
