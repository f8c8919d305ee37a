"""Named query plans over the star-schema tables, each with a SQL twin where one exists."""
