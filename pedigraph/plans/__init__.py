"""End-to-end plans: the verbs of the command line."""
