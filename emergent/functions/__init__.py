"""Type lattice, JSON and temporal parsing, and the SQL functions built on them."""
