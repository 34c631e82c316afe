"""Rules, templates and whole reconciliation runs, compiled to DataFrame plans."""
