"""Named queries over the star-schema tables, and the SQL that gives the same rows."""
