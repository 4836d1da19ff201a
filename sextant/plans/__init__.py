"""The roles that operators need, taken from the driver's tables, and the queries over them."""
