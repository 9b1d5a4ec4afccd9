"""Frame-to-frame operators over all accounts at once."""
