"""Text functions on columns: normalising, entities, similarity, polarity, years, sports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import values as V


def sure(predicate: Column) -> Column:
    """False where the predicate is null: a missing value never matches a drop filter."""
    return F.coalesce(predicate, F.lit(False))


def normalize(c: Column) -> Column:
    """Lower case; all but letters, digits, ``_`` and blanks become blanks, runs of blanks one; trimmed."""
    plain = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def split_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def tokens(c: Column) -> Column:
    return split_tokens(normalize(c))


def is_digits(t: Column) -> Column:
    return t.rlike(r"^\p{Nd}+$")


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def entity(title_tokens: Column, shared: Column, alone: Column, stop: list[str]) -> Column:
    """What tells a title from its siblings: without stop words and the tokens that all have, order and repeats kept.

    A title that is ``alone`` on its side loses digit tokens instead of shared ones. Each token is asked by itself: a set that is made
    within a lambda is made once a token.
    """
    known = F.coalesce(shared, F.array().cast("array<string>"))
    kept = F.filter(title_tokens, lambda t: ~t.isin(*stop))
    return F.array_join(F.when(alone, F.filter(kept, lambda t: ~is_digits(t))).otherwise(F.filter(kept, lambda t: ~F.array_contains(known, t))), " ")


def ticker_suffix(ticker: Column, least_parts: int) -> Column:
    """The last part of a ticker in lower case; empty where it has fewer parts."""
    parts = F.split(ticker, "-")
    return F.when(F.size(parts) >= least_parts, F.lower(F.element_at(parts, -1))).otherwise("")


def is_placeholder(e: Column, strategy: str) -> Column:
    nouns = "|".join(V.PLACEHOLDER_NOUNS)
    whole = "|".join(p.replace(" ", r"\s+") for p in V.PLACEHOLDERS[strategy])
    return F.lower(F.trim(e)).rlike(rf"^(?:(?:{nouns})\s+[a-z0-9]{{1,3}}|{whole})$")


def token_set(e: Column) -> Column:
    """The distinct tokens of an entity."""
    return F.array_distinct(split_tokens(e))


def traits(tokens: Column) -> Column:
    """What guards ask of one token set: how many tokens are digits, whether one compares, and both kinds of tokens in order, as text."""
    digits = F.filter(tokens, is_digits)
    text = [F.array_join(F.sort_array(t), " ") for t in (digits, F.array_except(tokens, digits))]
    return F.struct(F.size(digits).alias("n_digits"), F.arrays_overlap(tokens, words(V.DIRECTIONAL)).alias("compares"), text[0].alias("digits"), text[1].alias("others"))


def similarity(a: Column, b: Column, s: V.Strategy, sides: tuple[Column, Column, Column, Column] | None = None) -> Column:
    """Overlap coefficient of the token sets, 1 for equal entities, 0 where a guard of the strategy speaks against it.

    The larger of Jaccard and overlap is always the overlap, as a union is no smaller than the shorter side. ``sides`` are the token
    set and the traits of either, where they are columns already. What pairs share is counted last, as all else is known by side.
    """
    x, tx, y, ty = sides or (*((e := token_set(a)), traits(e)), *((e := token_set(b)), traits(e)))
    short, long = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    guards = [short < 2]
    if s.digits_exact:
        guards.append((2 * tx["n_digits"] > F.size(x)) & (2 * ty["n_digits"] > F.size(y)))
    if s.direction_exact:
        guards += [t["compares"] & (t["n_digits"] > 0) for t in (tx, ty)]
    if s.digit_divergence:
        guards.append((tx["n_digits"] > 0) & (ty["n_digits"] > 0) & (tx["others"] == ty["others"]) & (tx["digits"] != ty["digits"]))
    shared = F.size(F.array_intersect(x, y))
    score = shared / short
    if s.bundle_from is not None:  # none shared gives 0 by itself
        score = F.when((short >= s.bundle_from) & (3 * shared <= long), 0.0).otherwise(score)
    return F.when(a == b, 1.0).when(reduce(lambda p, q: p | q, guards), 0.0).otherwise(score)


def has_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda p, q: p | q, (F.contains(text, F.lit(w)) for w in phrases))


def _opposed(a_one: Column, a_other: Column, b_one: Column, b_other: Column) -> Column:
    """One side has only the first sign, the other side only the second."""
    return sure((a_one & ~a_other & b_other & ~b_one) | (a_other & ~a_one & b_one & ~b_other))


def opposing_direction(a: Column, b: Column, a_entity: Column, b_entity: Column) -> Column:
    """Asked of pairs with a digit in an entity only."""
    q, r = F.lower(a), F.lower(b)
    signs = [has_any(t, w) for t in (q, r) for w in ([*V.LESS, "<"], [*V.MORE, ">"])]
    return (a_entity.rlike(r"\p{Nd}") | b_entity.rlike(r"\p{Nd}")) & _opposed(*signs)


def polarity_inversion(a: Column, b: Column) -> Column:
    q, r = F.lower(a), F.lower(b)
    return _opposed(*(has_any(t, w) for t in (q, r) for w in (V.INCLUSION, V.EXCLUSION)))


def ticker_year_conflict(question: Column, ticker: Column, current_year: int) -> Column:
    """A ticker's year and all current or later years of the question are more than one year apart."""
    digits = F.regexp_extract(ticker, r"-(\d{2})(?=[A-Z-]|$)", 1)
    year = F.when(digits != "", F.lit(2000) + F.try_to_number(digits, F.lit("99")).cast("int"))
    years = F.filter(F.transform(F.regexp_extract_all(question, F.lit(r"(20[2-4]\d)"), F.lit(1)), lambda y: y.cast("int")), lambda y: y >= current_year)
    return sure(year.isNotNull() & (F.size(years) > 0) & ~F.exists(years, lambda y: F.abs(y - year) <= 1))


MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def effective_year(text: Column) -> Column:
    """The year a deadline falls in: the first decisive mention, else the first year, null without one."""
    t = F.lower(text)
    years = F.regexp_extract_all(t, F.lit(r"(20[2-3]\d)"), F.lit(1))

    def decided(y: Column) -> Column:
        dated = F.regexp_like(t, F.concat(F.lit(rf"(?:by|before)\s+{MONTH}(?U:\w*)\.?\s+\d{{1,2}},?\s+"), y))
        bare = F.regexp_like(t, F.concat(F.lit(r"(?:by|before)\s+"), y))
        during = F.regexp_like(t, F.concat(F.lit(r"(?:in|during)\s+"), y))
        return F.when(dated, y.cast("int")).when(bare, y.cast("int") - 1).when(during, y.cast("int"))

    found = F.filter(F.transform(years, decided), lambda y: y.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.try_element_at(years, F.lit(1)).cast("int"))


def timeframes_differ(a: Column, b: Column) -> Column:
    return sure(effective_year(a) != effective_year(b))


def title_sport(title: Column) -> Column:
    t = F.lower(title)
    return F.coalesce(*(F.when(t.rlike("|".join(of)), sport) for sport, of in V.TITLE_SPORTS))


def ticker_sport(ticker: Column) -> Column:
    t = F.upper(ticker)
    rules = sorted(V.TICKER_SPORTS.items(), key=lambda r: -len(r[0]))
    return F.coalesce(*(F.when(t.startswith(p), sport) for p, sport in rules))


def sports_differ(title: Column, ticker: Column) -> Column:
    return sure(title_sport(title) != ticker_sport(ticker))


def dropped_contract(question: Column, strategy: str) -> Column:
    """Spreads, totals and other contracts that a strategy doesn't align."""
    if strategy in V.PATTERN_DROPS:
        return sure(question.rlike("(?i)" + "|".join(V.PATTERN_DROPS[strategy])))
    literal = has_any(question, V.LITERAL_DROPS[strategy])
    return sure(literal | question.startswith(V.SPREAD_PREFIX) if strategy == "S1" else literal)
