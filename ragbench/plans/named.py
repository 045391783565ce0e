"""What an experiment's configuration may name, by kind: dicts of names to functions, to which a user may add their own."""

from __future__ import annotations

from ragbench.functions.vectors import hash_embedding
from ragbench.operators import chunking, graph, metrics, retrieval, techniques

REGISTERED: dict[str, dict] = {
    "chunkers": chunking.CHUNKERS,
    "embedders": {"hash": hash_embedding},
    "retrievers": {"similarity": retrieval.similarity, "mmr": retrieval.mmr, "multi_query": retrieval.multi_query, "parent_document": retrieval.parent_document},
    "techniques": {
        "naive": techniques.prompts, "closed_book": techniques.prompts, "oracle": techniques.oracle_contexts, "hyde": techniques.answers, "rerank": techniques.rerank, "crag": techniques.corrected,
        "compression": techniques.compressed, "agentic": techniques.agentic, "graph": graph.graph_retrieve, "graph_mix": techniques.united,
    },
    "metrics": {"rouge_l": metrics.rouge_l, "token_f1": metrics.token_f1, "chrf": metrics.chrf, "gold": metrics.gold_metrics, "embedding": metrics.embedding_metrics},
}


def register(kind: str, name: str, function) -> None:
    """A name once given stays: another function under it is an error."""
    known = REGISTERED.setdefault(kind, {})
    if known.get(name, function) is not function:
        raise ValueError(f"{name} is registered already among {kind}")
    known[name] = function


def get(kind: str, name: str):
    if name not in REGISTERED.get(kind, {}):
        raise KeyError(f"unknown {kind} {name}; known: {', '.join(sorted(REGISTERED.get(kind, {})))}")
    return REGISTERED[kind][name]
