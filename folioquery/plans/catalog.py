"""All queries of the library and their SQL twins."""

from folioquery.plans import q_align, q_corpus, q_forms, q_graph, q_layout, q_payloads, q_records, q_sources, registry

__all__ = ["q_align", "q_corpus", "q_forms", "q_graph", "q_layout", "q_payloads", "q_records", "q_sources"]


def queries() -> dict:
    return registry.QUERIES


def oracle_sql() -> dict:
    return registry.SQL
