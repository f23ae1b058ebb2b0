"""Operators for language-model training data; nothing outside this subpackage imports it."""

QUERY_MODULES = [
    "orrery.llm.q_terms",
    "orrery.llm.q_near",
    "orrery.llm.q_markup",
    "orrery.llm.q_turns",
    "orrery.llm.q_leaks",
    "orrery.llm.q_spans",
    "orrery.llm.q_mixing",
]
