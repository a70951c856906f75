"""Sources: archives, directories, tree dumps, run history."""
