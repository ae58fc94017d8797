"""Column functions. Every function takes Columns (or column names) and returns a Column."""
