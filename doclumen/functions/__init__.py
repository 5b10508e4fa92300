"""Column expressions: no data is read, shuffled or collected here."""
