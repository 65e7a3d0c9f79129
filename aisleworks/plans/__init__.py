"""End-to-end jobs: the operators wired to tables, with argument checks and presentation order."""
