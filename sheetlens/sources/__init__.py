"""Reading tables in, writing tables and results out."""
