"""Constants of scoring, retrieval and reports, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, field


def _map(**values):
    return field(default_factory=lambda: dict(values))


# Weights, factors, baselines and thresholds that results depend on.
@dataclass(frozen=True)
class Scoring:
    retriever_weights: dict = _map(dense=0.35, sparse=0.40, graph=0.25)
    other_weight: float = 0.33
    sparse_baseline: float = 1250.0
    graph_baseline: float = 2.8
    abstraction: dict = _map(base=1.3, variant=1.2, **{"class": 0.8}, pillar=0.6)
    usage: dict = field(default_factory=lambda: {"ALLOWED": 1.1, "ALLOWED-WITH-REVIEW": 1.05, "DISCOURAGED": 0.8, "PROHIBITED": 0.5})
    relationship_step: float = 0.15
    relationship_most: float = 0.45
    phrase_boosts: dict = _map(rootcause=2.0, weakness=1.8)


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class Retrieval:
    k: int = 10
    agent_k: int = 5
    dense_threshold: float = 0.3
    near_zero: float = 0.0001
    relevance_floor: float = 0.1
    graph_floor: float = 0.05
    vector_share: float = 0.4
    seeds_each: int = 5


@dataclass(frozen=True)
class Graph:
    sequence: tuple = ("CANPRECEDE", "CANFOLLOW", "REQUIRES", "REQUIREDBY")
    forward: tuple = ("CANPRECEDE", "REQUIRES")
    peer: tuple = ("PEEROF", "CANALSOBE")
    hierarchy: tuple = ("CHILDOF", "PARENTOF")
    reciprocal: dict = _map(CHILDOF="PARENTOF", PARENTOF="CHILDOF", CANPRECEDE="CANFOLLOW", CANFOLLOW="CANPRECEDE", REQUIRES="REQUIREDBY", REQUIREDBY="REQUIRES")
    edge_weights: dict = _map(CANPRECEDE=1.0, CANFOLLOW=1.0, REQUIRES=0.9, REQUIREDBY=0.9, PEEROF=0.7, CANALSOBE=0.7, CHILDOF=0.3, PARENTOF=0.3)
    strategy_weights: dict = _map(explicit_mention=1.0, keyword_match=0.8, relationship_chain=0.9, chain_starting_point=0.85, vulnerability_chain=0.9, abstraction_path=0.7, sequence_path=0.8, peer_group=0.6, relationship_richness=0.5)


@dataclass(frozen=True)
class Cost:
    """Prices for a thousand tokens, and words to a token."""

    input_per_1k: float = 0.0001
    output_per_1k: float = 0.0004
    words_per_token: float = 0.75


SCORING, BM25, RETRIEVAL, GRAPH, COST = Scoring(), Bm25(), Retrieval(), Graph(), Cost()


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights, if none is negative and they sum to one."""
    if min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError(f"weights must be non-negative and sum to 1: {weights}")
    return weights


def shifted_weights(weights: dict[str, float], has_phrases: bool, shift: float = 0.15) -> dict[str, float]:
    """With keyphrases the sparse retriever gains ``shift``, at the others' expense in proportion."""
    if not has_phrases:
        return dict(weights)
    sparse = min(weights["sparse"] + shift, 1.0)
    rest = 1 - weights["sparse"]
    return {k: sparse if k == "sparse" else w * (1 - sparse) / rest for k, w in weights.items()}


def configured(values: dict, scoring: Scoring = SCORING, retrieval: Retrieval = RETRIEVAL) -> tuple[Scoring, Retrieval]:
    """Scoring and retrieval constants with the given values in place of the defaults; unknown names are an error.

    values may have the sections scoring and retrieval; the older name
    ``weights`` stands for ``scoring.retriever_weights``.
    """
    from dataclasses import replace

    own = dict(values.get("scoring", {}))
    if "weights" in values:
        own.setdefault("retriever_weights", values["weights"])
    unknown = set(values) - {"scoring", "retrieval", "weights"}
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    scoring, retrieval = replace(scoring, **own), replace(retrieval, **values.get("retrieval", {}))
    checked_weights(scoring.retriever_weights)
    return scoring, retrieval


def template(path: str) -> str:
    """The text of a prompt template."""
    with open(path, encoding="utf-8") as f:
        return f.read()
