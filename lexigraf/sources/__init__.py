"""Sources and sinks: Git repositories, chunkers, the versioned store, run files."""
