"""Files in, tables and reports out."""
