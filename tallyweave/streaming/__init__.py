"""Incremental runs: files taken once each as a stream, and the state that says what a run has to look at."""
