"""The query catalogue over the driver tables, its SQL, and the three jobs."""
