"""Parts by kind and name: what a configuration chooses from."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import text
from ..operators import ensemble, esa, knn, normalize, phrases, similarity, wikify

_PARTS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, part: Callable | None = None):
    """Adds a part, or as a decorator the function below; a name is taken once."""
    if part is None:
        return lambda f: register(kind, name, f)
    if (kind, name) in _PARTS:
        raise ValueError(f"{kind} {name} is there already")
    _PARTS[kind, name] = part
    return part


def get(kind: str, name: str) -> Callable:
    return _PARTS[kind, name]


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _PARTS if k == kind)


for _kind, _parts in {
    "metric": {"inlink": similarity.inlink, "outlink": similarity.outlink, "milne-witten": similarity.milne_witten, "direct-link": similarity.direct_link, "syn-rank": similarity.syn_rank},
    "vector similarity": {"cosine": similarity.cosine, "google": similarity.google},
    "normalizer": {"identity": normalize.Identity, "range": normalize.Range, "log": normalize.Log, "percentile": normalize.Percentile, "loess": normalize.Loess, "rank-and-score": normalize.RankAndScore},
    "ensemble": {"even": ensemble.even, "linear": ensemble.Linear, "correlation": ensemble.Correlation, "weighted": ensemble.weighted},
    "neighbours": {"brute-force": knn.brute_force, "random-projection": knn.RandomProjection, "lsh-forest": knn.LshForest, "k-means-tree": knn.KMeansTree, "two-means-tree": knn.TwoMeansTree},
    "disambiguator": {"top": phrases.top_sense, "consensus": phrases.consensus, "similarity": phrases.by_similarity, "milne-witten": phrases.milne_witten_senses},
    "wikifier": {"identity": wikify.identity, "milne-witten": wikify.milne_witten, "combined": wikify.combined},
    "string normalizer": {"identity": lambda t: t, "simple": text.normalise, "fold-case": text.fold_case, "stemmed": text.stemmed},
    "vector generator": {"links": similarity.link_vectors, "texts": esa.text_vectors, "most similar concepts": esa.concept_vectors},
    "phrase vectors": {"candidates": similarity.phrase_vectors, "by mode": esa.phrase_vectors_by},
}.items():
    for _name, _part in _parts.items():
        register(_kind, _name, _part)
