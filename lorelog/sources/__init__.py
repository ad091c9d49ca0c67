"""Where commit logs come from and where reports go."""
