"""Named queries over the star-schema tables, and the SQL they are held against."""
