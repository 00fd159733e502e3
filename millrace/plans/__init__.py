"""Named queries over the driver tables, each with its checking SQL where SQL can say it."""
