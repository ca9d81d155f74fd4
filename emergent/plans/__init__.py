"""Plan rewriting, the SQL front end and the registered queries."""
