"""DataFrame operators: retrieval, spans, graphs, events, corpora, metrics and checks."""
