"""Project files, documentation files and package directories as DataFrames."""
