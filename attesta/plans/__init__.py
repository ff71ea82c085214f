"""Named queries over the record tables, each beside the SQL that says the same."""
