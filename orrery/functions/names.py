"""Name and token similarity for entity resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(name: Column) -> Column:
    """Lower case, without punctuation and combining marks, white space of any kind collapsed."""
    bare = F.regexp_replace(F.lower(name), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))


def words(name: Column) -> Column:
    """tokens() of a normalised name, which has no white space but single blanks."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct tokens; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def token_score(x: Column, y: Column, x_tokens: Column, y_tokens: Column) -> Column:
    """1 for equal normalised names, else the similarity of their tokens; 0 where one is missing or empty."""
    missing = x.isNull() | y.isNull() | (x == "") | (y == "")
    return F.when(missing, 0.0).when(x == y, 1.0).otherwise(jaccard(x_tokens, y_tokens))


def name_score(a: Column, b: Column) -> Column:
    """token_score of two names as they are written."""
    x, y = normalized(a), normalized(b)
    return token_score(x, y, tokens(x), tokens(y))


def spread(values: Column) -> Column:
    """The distinct tokens of an array of names."""
    return F.array_distinct(F.flatten(F.transform(values, lambda x: words(normalized(x)))))


def shared_or_similar(a: Column, b: Column, a_tokens: Column | None = None, b_tokens: Column | None = None) -> Column:
    """1 where two arrays of names share one, else the similarity of all their tokens; 0 where one is empty."""
    similar = jaccard(spread(a) if a_tokens is None else a_tokens, spread(b) if b_tokens is None else b_tokens)
    return F.when((F.size(a) < 1) | (F.size(b) < 1), 0.0).when(F.arrays_overlap(a, b), 1.0).otherwise(similar)


def json_values(attributes: Column, keys: tuple[str, ...]) -> Column:
    """The values that a JSON object has under some keys, without missing ones."""
    return F.array_compact(F.array(*(F.get_json_object(attributes, f"$.{k}") for k in keys)))
