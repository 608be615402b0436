"""Stream forms of operators; each has a batch form that gives the same rows."""
