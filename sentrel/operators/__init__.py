"""DataFrame operators: scans, structure, taint, routes, verdicts and roll-ups."""
