"""Where the corpus, the rules and the evidence come from, and where reports go."""
