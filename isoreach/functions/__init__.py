"""Column expressions and naming rules. Nothing here runs a job."""
