"""Sources: landing files, CDC tables, config tables, driver-table stand-ins."""
