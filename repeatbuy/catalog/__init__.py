"""Named queries on a source folder, and the SQL that checks them."""
