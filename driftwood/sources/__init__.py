"""Reading tables and files, and the shared folder for intermediate tables."""
