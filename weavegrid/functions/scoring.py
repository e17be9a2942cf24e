"""Column functions of score fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weavegrid.functions.config import SCORING, Scoring


def choice(value: Column, factors: dict[str, float], otherwise: float = 1.0) -> Column:
    first, *rest = factors.items()
    case = reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), rest, F.when(value == first[0], F.lit(first[1])))
    return case.otherwise(F.lit(otherwise))


def normalized(retriever: Column, score: Column, s: Scoring = SCORING) -> Column:
    """A raw score as a share of its retriever's baseline, one at most."""
    base = F.when(retriever == "sparse", F.lit(s.sparse_baseline)).when(retriever == "graph", F.lit(s.graph_baseline)).otherwise(F.lit(1.0))
    return F.least(score / base, F.lit(1.0))


def retriever_weight(retriever: Column, s: Scoring = SCORING) -> Column:
    return choice(retriever, s.retriever_weights, s.other_weight)


def abstraction_factor(kind: Column, s: Scoring = SCORING) -> Column:
    return choice(F.lower(kind), s.abstraction)


def usage_factor(usage: Column, s: Scoring = SCORING) -> Column:
    return choice(F.upper(usage), s.usage)


def relationship_bonus(graph_only: Column, n_relations: Column, s: Scoring = SCORING) -> Column:
    bonus = F.least(n_relations * F.lit(s.relationship_step), F.lit(s.relationship_most)) + 1.0
    return F.when(graph_only & (n_relations > 0), bonus).otherwise(F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision."""
    return dot(a, b) / (norm(a) * norm(b))


def shared_factor(n_retrievers: Column, average: Column) -> Column:
    """The documented variant: what two or three retrievers agree on counts for more, by their average score."""
    boost = F.when(n_retrievers >= 3, F.lit(2.0)).when(n_retrievers == 2, F.lit(1.5)).otherwise(F.lit(1.0))
    return 1.0 + (boost - 1.0) * F.least(average * 2.5, F.lit(1.0))
