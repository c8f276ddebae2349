"""All queries of the library outside the subpackage for training data."""

from partloom.functions import attributes, availability, extraction, text_keys, vocabularies
from partloom.operators import aggregates, assessment, checks, constraints, evaluation, learned, matching, predicates, ranking, search_modes, state, text_search
from partloom.plans import best_offers, response
from partloom.registry import QUERIES, SQL
from partloom.sources import catalogue_sources
from partloom.streaming import counters

__all__ = ["QUERIES", "SQL", "aggregates", "assessment", "attributes", "availability", "best_offers", "catalogue_sources", "checks", "constraints", "counters", "evaluation", "extraction", "learned", "matching", "predicates", "ranking", "response", "search_modes", "state", "text_keys", "text_search", "vocabularies"]
