"""Query catalogue: every query beside its SQL statement."""
