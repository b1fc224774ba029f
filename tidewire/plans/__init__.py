"""Named queries: operators over the tables, each with the SQL it is held against where SQL can express it."""
