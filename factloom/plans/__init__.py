

from factloom.plans import answers, catalog, claims, comparisons, discovery, documents, figures, knowledge, propositions, reasoning, trees, verdicts, works  # noqa: E402, F401
