"""From an input line to a DataFrame plan: query model, compilers, predicates, ranking and the engine."""
