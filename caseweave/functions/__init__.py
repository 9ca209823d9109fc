"""Column functions: text, geometry, addresses and identities."""
