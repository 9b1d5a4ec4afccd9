"""The operators bound to the driver's test tables, each beside its SQL."""
