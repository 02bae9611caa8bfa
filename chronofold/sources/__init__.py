"""Sources: archives of JSON histories."""
