"""Named queries over a graph folder, each with the SQL that checks it where SQL can express it."""
