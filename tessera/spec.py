"""What one search asks for, and the constants that are part of the results."""

from __future__ import annotations

from dataclasses import dataclass, field

import regex

# Fixed values.
MAX_SCORED_FILES, DISCOVERY_SOURCES, COCHANGE_SOURCES, COCHANGE_LIMIT, MAX_EXTRAS, MIN_COCHANGE = 200, 30, 20, 20, 50, 2
MAX_FILE_BYTES = 2_000_000
BUDGET_CAP = 150
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60
MAX_PER_FILE = 2
DIMENSION, SEQUENCE, BATCH = 384, 128, 256
CHUNK_SIZE, OVERLAP, MIN_TOKENS = 512, 0.2, 5

_NOT_WORD = regex.compile(r"[^\p{Alphabetic}\p{N}_]+")


def query_terms(query: str, literals: tuple[str, ...] = ()) -> list[str]:
    """Words of at least two bytes, in lower case, repeats kept; then each literal that is not yet there."""
    terms = [w.lower() for w in _NOT_WORD.split(query) if len(w.encode()) >= 2]
    for x in literals:
        if not x:
            raise ValueError("a literal must not be empty")
        if x.lower() not in terms:
            terms.append(x.lower())
    return terms


def valid_query(query: str) -> bool:
    """Whether any blank-separated word has at least two bytes."""
    return any(len(w.encode()) >= 2 for w in query.split())


def candidate_budget(n_terms: int, top: int) -> int:
    """How many chunks the lexical filter lets through to the embedding."""
    return min((3 if n_terms <= 2 else 5 if n_terms <= 4 else 8) * max(top, 10), BUDGET_CAP)


@dataclass(frozen=True)
class SearchSpec:
    query: str
    top: int = 10
    threshold: float | None = None
    context: int = 2
    glob: str | None = None
    chunk_size: int = CHUNK_SIZE
    overlap: float = OVERLAP
    hidden: bool = False
    no_gitignore: bool = False
    literals: tuple[str, ...] = ()
    fast: bool = False
    terms: list[str] = field(init=False)

    def __post_init__(self) -> None:
        if not valid_query(self.query):
            raise ValueError("the query needs a word of at least two characters")
        if self.chunk_size < 1:
            raise ValueError("chunk_size must be positive")
        object.__setattr__(self, "terms", query_terms(self.query, self.literals))

    @property
    def words(self) -> list[str]:
        """The terms that BM25 scores: those of the query, without the literals."""
        return query_terms(self.query)

    @property
    def budget(self) -> int:
        return candidate_budget(len(self.terms), self.top)
