"""Set-at-a-time operators on candidate, message and posting tables."""
