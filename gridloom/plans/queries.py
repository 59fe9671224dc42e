"""The registered queries: each applies operators of the package to the tables, with its DuckDB counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import pricing as P
from gridloom.functions import text as X
from gridloom.functions import values as V
from gridloom.functions.dates import iso_millis
from gridloom.operators import align, books, merge, signals
from gridloom.plans import inputs as I
from gridloom.sources import feeds

T = V.Thresholds()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def any_of(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- scans and row filters ----


@query("scan_category", "SELECT c_mktsegment AS category, count(*) AS n FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') GROUP BY 1")
def scan_category(spark: SparkSession, d: str) -> DataFrame:
    rows = I.read(spark, d, "customer").where(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"))
    return merge.value_counts(rows.select(F.col("c_mktsegment").alias("category")), "category")


@query("split_h2h", """
SELECT p_partkey AS idx, CASE WHEN coalesce(contains(lower(title), ' vs'), false) THEN 'S2' ELSE 'S3' END AS strategy
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_name || ' VS ' || p_brand ELSE p_name || ' cup' END AS title FROM part)""")
def split_h2h(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 7 == 0, None).when(k % 3 == 0, F.concat("p_name", F.lit(" VS "), "p_brand")).otherwise(F.concat("p_name", F.lit(" cup")))
    return I.read(spark, d, "part").select(k.alias("idx"), F.when(X.sure(F.contains(F.lower(title), F.lit(" vs"))), "S2").otherwise("S3").alias("strategy"))


@query("contract_filters", r"""
SELECT idx, contains(q, 'More Markets') OR contains(q, 'Lower Strikes') OR contains(q, 'Lower strikes') OR contains(q, 'Toss Match Double') OR starts_with(q, 'Spread:') AS s1,
  regexp_matches(q, '(?i)^Spread:|^Over |^Under |Total |More Markets|Lower Strikes|Toss Match|Handicap|end in a draw|Draw at halftime') AS s2,
  regexp_matches(q, '(?i)^Spread:|^Over |^Under |Total |More Markets|Lower Strikes|Toss Match|Handicap') AS s3,
  contains(q, 'More Markets') OR contains(q, 'Lower Strikes') AS s4
FROM (SELECT p_partkey AS idx, CASE p_partkey % 8 WHEN 0 THEN 'Spread: ' WHEN 1 THEN 'over ' WHEN 2 THEN 'total ' WHEN 3 THEN 'x spread: ' ELSE '' END || p_name ||
  CASE p_partkey % 9 WHEN 0 THEN ' - More Markets' WHEN 1 THEN ' more markets' WHEN 2 THEN ' Lower strikes' WHEN 3 THEN ' will end in a draw' WHEN 4 THEN ' Toss Match Double' ELSE '' END AS q FROM part)""")
def contract_filters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    before = F.when(k % 8 == 0, "Spread: ").when(k % 8 == 1, "over ").when(k % 8 == 2, "total ").when(k % 8 == 3, "x spread: ").otherwise("")
    after = F.when(k % 9 == 0, " - More Markets").when(k % 9 == 1, " more markets").when(k % 9 == 2, " Lower strikes").when(k % 9 == 3, " will end in a draw").when(k % 9 == 4, " Toss Match Double").otherwise("")
    rows = I.read(spark, d, "part").select(k.alias("idx"), F.concat(before, "p_name", after).alias("q"))
    return rows.select("idx", *(X.dropped_contract(F.col("q"), s).alias(s.lower()) for s in ("S1", "S2", "S3", "S4")))


@query("event_dedup", """
SELECT o_custkey AS cust, min(o_orderkey) AS idx FROM (
  SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'x - More Markets' WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'World GDP' END AS title FROM orders)
WHERE NOT coalesce(contains(title, 'More Markets'), false) AND NOT coalesce(o_custkey = 26 AND regexp_matches(title, 'China|UK|World'), false) GROUP BY 1""")
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, "x - More Markets").when(k % 7 == 0, None).otherwise("World GDP")
    ticker = F.when(F.col("o_custkey") == 26, V.GDP_TICKER).otherwise(F.concat(F.lit("KX"), F.col("o_custkey").cast("string")))
    rows = I.read(spark, d, "orders").select(k.alias("ordinal"), "o_custkey", title.alias("a_event_title"), ticker.alias("b_event_ticker"))
    return merge.dedup_events(rows, V.STRATEGIES["S4"]).select(F.col("o_custkey").alias("cust"), F.col("ordinal").alias("idx"))


@query("market_json", """
SELECT p_partkey AS idx, p_name AS question, 'y' || CAST(p_partkey AS VARCHAR) AS yes_token, 'n' || CAST(p_partkey AS VARCHAR) AS no_token
FROM part WHERE NOT (p_partkey % 2 = 0 AND NOT p_partkey % 6 = 0) AND p_partkey % 5 <> 0""")
def market_json(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.sources import markets

    k = F.col("p_partkey")
    token_list = F.when(k % 5 == 0, "[broken").otherwise(F.concat(F.lit('["y'), k.cast("string"), F.lit('", "n'), k.cast("string"), F.lit('"]')))
    market = F.struct(F.col("p_name").alias("question"), (k % 2 == 0).alias("closed"), (k % 6 == 0).alias("active"), token_list.alias("clobTokenIds"), k.cast("string").alias("conditionId"))
    rows = I.read(spark, d, "part").select(k.cast("string").alias("event_id"), F.to_json(F.struct(F.array(market).alias("markets"))).alias("body"))
    found = markets.a_markets(rows, "S4")
    return found.select(F.col("event_id").cast("bigint").alias("idx"), "question", "yes_token", "no_token")


@query("open_markets", """
SELECT p_partkey AS idx, 'K-' || CAST(p_partkey AS VARCHAR) AS ticker, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS yes_sub_title, CASE p_partkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'active' ELSE 'unopened' END AS status
FROM part WHERE p_partkey % 5 < 3""")
def open_markets(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.sources import markets

    k = F.col("p_partkey")
    status = F.element_at(X.words(["open", "active", "unopened", "closed", "settled"]), (k % 5 + 1).cast("int"))
    market = F.struct(F.concat(F.lit("K-"), k.cast("string")).alias("ticker"), F.col("p_name").alias("title"), F.when(k % 2 == 0, F.col("p_type")).alias("yes_sub_title"), status.alias("status"))
    body = F.struct(F.array(market).alias("markets"))
    wrapped = F.when(k % 3 == 0, F.to_json(F.struct(body.alias("event")))).otherwise(F.to_json(body))
    rows = I.read(spark, d, "part").select(k.cast("string").alias("event_id"), wrapped.alias("body"))
    return markets.b_markets(rows).select(F.col("event_id").cast("bigint").alias("idx"), "ticker", "title", "yes_sub_title", "status")


# ---- text ----


@query("normalise", r"""
SELECT doc_id, md5(n) AS md5_normal, len(list_filter(string_split(n, ' '), lambda t: t <> '')) AS n_tokens FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM documents)""")
def normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = I.read(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("n"))
    return rows.select("doc_id", F.md5("n").alias("md5_normal"), F.size(X.split_tokens(F.col("n"))).cast("bigint").alias("n_tokens"))


@query("doc_frequency", r"""
SELECT lang, token, count(*) AS df FROM (
  SELECT lang, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: t <> ''))) AS token
  FROM documents) GROUP BY 1, 2""")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = I.read(spark, d, "documents").select("lang", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    return rows.groupBy("lang", "token").agg(F.count("*").alias("df"))


def _entity_sql(s: str) -> str:
    stop = sql_list(V.STRATEGIES[s].stop)
    return rf"""{I.TITLES}, toks AS (
  SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: t <> '') AS ts,
    count(*) OVER (PARTITION BY event, side) AS n FROM titles
), dfs AS (SELECT event, side, t, count(*) AS df, min(n) AS n FROM (SELECT event, side, n, unnest(list_distinct(ts)) AS t FROM toks) GROUP BY 1, 2, 3
), shared AS (SELECT event, side, list(t) AS scaffold FROM dfs WHERE df = n GROUP BY 1, 2
), entities AS (
  SELECT event, side, idx, title, ticker, n, array_to_string(list_filter(ts, lambda t: NOT list_contains({stop}, t)
    AND CASE WHEN n = 1 THEN NOT regexp_matches(t, '^[0-9]+$') ELSE NOT coalesce(list_contains(scaffold, t), false) END), ' ') AS entity
  FROM toks LEFT JOIN shared USING (event, side))"""


@query("entities", f"WITH {_entity_sql('S1')} SELECT event, side, idx, entity, n FROM entities")
def entities(spark: SparkSession, d: str) -> DataFrame:
    return align.with_entities(I.titles(spark, d), V.STRATEGIES["S1"]).select("event", "side", "idx", "entity", "n")


def _normal_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("fallback_entities", f"""WITH b AS (
  SELECT p_partkey // 4 AS event, p_partkey AS idx, CASE WHEN (p_partkey // 4) % 3 = 2 THEN p_name || ' ' || p_type WHEN p_partkey % 2 = 0 THEN 'Same title?' ELSE 'same  title' END AS title,
    CASE (p_partkey // 4) % 3 WHEN 0 THEN p_name WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN '' END ELSE p_name END AS sub,
    CASE WHEN p_partkey % 5 = 0 THEN 'KX-P' ELSE 'KX-26-P' END || CAST(p_partkey AS VARCHAR) AS ticker FROM part
), stats AS (SELECT event, count(*) AS n, count(DISTINCT {_normal_sql('title')}) AS titles, count(DISTINCT CASE WHEN coalesce(sub, '') <> '' THEN {_normal_sql('sub')} END) AS subs FROM b GROUP BY 1
), moded AS (SELECT *, CASE WHEN titles = 1 AND n > 1 THEN CASE WHEN subs > 1 THEN 'sub' ELSE 'suffix' END ELSE 'title' END AS mode FROM b JOIN stats USING (event)
), toks AS (SELECT event, idx, n, mode, ticker, list_filter(string_split({_normal_sql("CASE WHEN mode = 'sub' THEN coalesce(sub, '') ELSE title END")}, ' '), lambda t: t <> '') AS ts FROM moded
), dfs AS (SELECT event, t, count(*) AS df, min(n) AS n FROM (SELECT event, n, unnest(list_distinct(ts)) AS t FROM toks) GROUP BY 1, 2
), shared AS (SELECT event, list(t) AS scaffold FROM dfs WHERE df = n GROUP BY 1)
SELECT event, idx, CASE WHEN mode = 'suffix' THEN CASE WHEN len(string_split(ticker, '-')) >= 3 THEN lower(string_split(ticker, '-')[-1]) ELSE '' END ELSE
  array_to_string(list_filter(ts, lambda t: NOT list_contains({sql_list(V.STRATEGIES['S1'].stop)}, t) AND CASE WHEN n = 1 THEN NOT regexp_matches(t, '^[0-9]+$') ELSE NOT coalesce(list_contains(scaffold, t), false) END), ' ') END AS entity
FROM toks LEFT JOIN shared USING (event)""")
def fallback_entities(spark: SparkSession, d: str) -> DataFrame:
    """Events whose titles are all equal take their entities from sub-titles or tickers."""
    k, g = F.col("p_partkey"), F.floor(F.col("p_partkey") / 4)
    title = F.when(g % 3 == 2, F.concat_ws(" ", "p_name", "p_type")).when(k % 2 == 0, "Same title?").otherwise("same  title")
    sub = F.when(g % 3 != 1, F.col("p_name")).when(k % 2 == 0, "")
    ticker = F.concat(F.when(k % 5 == 0, "KX-P").otherwise("KX-26-P"), k.cast("string"))
    rows = I.read(spark, d, "part").select(g.alias("event"), k.alias("idx"), title.alias("title"), sub.alias("sub_title"), ticker.alias("ticker"))
    return align.b_entities(rows, V.STRATEGIES["S1"]).select("event", "idx", "entity")


def _pairs_sql(s: str) -> str:
    digits = "list_filter({0}, lambda t: regexp_matches(t, '^[0-9]+$'))"
    x, y = digits.format("x"), digits.format("y")
    st = V.STRATEGIES[s]
    guards = ["least(len(x), len(y)) < 2"]
    if st.digits_exact:
        guards.append(f"(2 * len({x}) > len(x) AND 2 * len({y}) > len(y))")
    if st.direction_exact:
        guards += [f"(len(list_intersect({k}, {sql_list(V.DIRECTIONAL)})) > 0 AND len({v}) > 0)" for k, v in (("x", x), ("y", y))]
    if st.digit_divergence:
        other = "list_sort(list_filter({0}, lambda t: NOT regexp_matches(t, '^[0-9]+$')))"
        guards.append(f"({other.format('x')} = {other.format('y')} AND len({x}) > 0 AND len({y}) > 0 AND list_sort({x}) <> list_sort({y}))")
    if st.bundle_from is not None:
        guards.append(f"(least(len(x), len(y)) >= {st.bundle_from} AND k > 0 AND greatest(len(x), len(y)) - k >= 2 * k)")
    placeholder = rf"AND NOT regexp_matches(a.entity, '^(?:(?:{'|'.join(V.PLACEHOLDER_NOUNS)})\s+[a-z0-9]{{1,3}}|another candidate|another player|other)$')" if st.anonymous else ""
    return f"""{_entity_sql(s)}, met AS (
  SELECT a.event, a.idx AS a_idx, b.idx AS b_idx, a.entity AS a_entity, b.entity AS b_entity,
    list_distinct(string_split(a.entity, ' ')) AS x, list_distinct(string_split(b.entity, ' ')) AS y
  FROM entities a JOIN entities b ON a.event = b.event AND a.side = 'a' AND b.side = 'b' AND a.entity <> '' AND b.entity <> '' {placeholder}
), sized AS (SELECT *, len(list_intersect(x, y)) AS k FROM met
), pairs AS (SELECT * FROM (
  SELECT event, a_idx, b_idx, CASE WHEN a_entity = b_entity THEN 1.0::DOUBLE WHEN {' OR '.join(guards)} THEN 0.0::DOUBLE
    ELSE k::DOUBLE / least(len(x), len(y)) END AS score FROM sized) WHERE score >= 0.5)"""


def _candidates(spark: SparkSession, d: str, s: str) -> DataFrame:
    titles = I.titles(spark, d)
    found = align.with_entities(titles, V.STRATEGIES[s])
    most = align.most_pairs(*(titles.where(F.col("side") == k) for k in ("a", "b")))
    return align.candidates(found.where("side = 'a'"), found.where("side = 'b'"), V.STRATEGIES[s], most=most)


def _score_query(s: str) -> None:
    @query(f"scores_{s.lower()}", f"WITH {_pairs_sql(s)} SELECT event, a_idx, b_idx, score FROM pairs")
    def scores(spark: SparkSession, d: str) -> DataFrame:
        return _candidates(spark, d, s).select("event", "a_idx", "b_idx", "score")


for _s in V.STRATEGIES:
    _score_query(_s)


_FOLDED = """sorted AS (
  SELECT event, list([{'a': a_idx, 'b': b_idx, 's': score}] ORDER BY score DESC, a_idx, b_idx) AS c FROM pairs GROUP BY 1
), folded AS (
  SELECT event, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a = x[1].a OR y.b = x[1].b)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS e FROM sorted
)"""
_CONFLICT = f"((2025 + a.idx % 4) >= {I.YEAR} AND abs((2025 + a.idx % 4) - (24 + b.idx % 6 + 2000)) > 1)"


@query("greedy", f"WITH {_pairs_sql('S2')}, {_FOLDED} SELECT event, e.a AS a_idx, e.b AS b_idx, round_even(e.s, 3) AS score FROM folded")
def greedy(spark: SparkSession, d: str) -> DataFrame:
    return align.assign(_candidates(spark, d, "S2")).select("event", "a_idx", "b_idx", F.bround("score", 3).alias("score"))


@query("direct_binary", f"""WITH {I.TITLES}, one AS (
  SELECT a.idx AS a_idx, b.idx AS b_idx, a.title AS a_title, b.title AS b_title FROM titles a JOIN titles b ON a.idx // 2 = b.idx // 2 AND a.side = 'a' AND b.side = 'b')
SELECT a_idx // 2 AS event, a_idx, b_idx, 1.0::DOUBLE AS score FROM one
WHERE CAST(regexp_extract(a_title, 'in (20[2-3][0-9])', 1) AS INT) = CAST(regexp_extract(b_title, 'in (20[2-3][0-9])', 1) AS INT)
  OR a_idx % 8 = 6""")
def direct_binary(spark: SparkSession, d: str) -> DataFrame:
    rows = I.titles(spark, d).withColumn("event", F.floor(F.col("idx") / 2).cast("bigint"))
    # of each eighth pair both sides name one year in two ways
    both = F.when(F.floor(F.col("idx") / 2) % 4 == 3, F.when(F.col("side") == "a", "Done before 2027?").otherwise("Done by Dec 31, 2026?")).otherwise(F.col("title"))
    rows = rows.withColumn("title", both)
    found = align.direct(rows.where("side = 'a'"), rows.where("side = 'b'"), V.STRATEGIES["S4"])
    return found.select("event", "a_idx", "b_idx", "score")


# ---- numeric brackets ----


@query("bounds", f"""WITH {I.BRACKETS} SELECT idx, CASE WHEN p % 3 = 0 THEN p_size::DOUBLE WHEN p % 3 = 2 THEN p_size::DOUBLE END AS lo,
  CASE WHEN p % 3 = 0 THEN (p_size + 5)::DOUBLE WHEN p % 3 = 1 THEN p_size::DOUBLE END AS hi FROM (SELECT *, idx AS p FROM brackets WHERE idx % 7 <> 6)""")
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return I.brackets(spark, d).withColumn("x", N.bounds(F.col("title"), "S5")).where("x is not null").select("idx", "x.lo", "x.hi")


@query("numeric_share", f"""WITH {I.BRACKETS} SELECT event, side, count(*) FILTER (idx % 7 <> 6) * 10 > count(*) * 3 AS is_numeric
FROM brackets GROUP BY 1, 2""")
def numeric_share(spark: SparkSession, d: str) -> DataFrame:
    rows = I.brackets(spark, d).withColumn("title", F.regexp_replace("title", "^At least", "Above"))
    return align.numeric_sides(rows, "S4")


@query("bound_pairs", f"""WITH {I.BRACKETS}, b AS (
  SELECT *, CASE WHEN idx % 3 <> 1 THEN p_size END AS lo, CASE WHEN idx % 3 = 0 THEN p_size + 5 WHEN idx % 3 = 1 THEN p_size END AS hi FROM brackets WHERE idx % 7 <> 6)
SELECT x.event, x.idx AS a_idx, min(y.idx) AS b_idx, '(' || coalesce(CAST(x.lo AS VARCHAR) || '.0', 'None') || ', ' || coalesce(CAST(x.hi AS VARCHAR) || '.0', 'None') || ')' AS a_entity
FROM b x JOIN b y ON x.event = y.event AND x.side = 'a' AND y.side = 'b' AND x.lo IS NOT DISTINCT FROM y.lo AND x.hi IS NOT DISTINCT FROM y.hi GROUP BY x.event, x.idx, x.lo, x.hi""")
def bound_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = I.brackets(spark, d)
    return align.same_bounds(rows.where("side = 'a'"), rows.where("side = 'b'"), "S4").select("event", "a_idx", "b_idx", "a_entity")


# ---- guards ----

_POLARITY = [any_of(t, w) for t in ("q", "r") for w in (V.INCLUSION, V.EXCLUSION)]
_DIRECTION = [any_of(t, w) for t in ("q", "r") for w in ([*V.LESS, "<"], [*V.MORE, ">"])]
_PHRASES = ["played in", "relocated away from", "stays with", "banned by", "under 5", "above 5", "government", "<70 seats"]


def _opposed_sql(a1: str, a2: str, b1: str, b2: str) -> str:
    return f"(({a1} AND NOT {a2} AND {b2} AND NOT {b1}) OR ({a2} AND NOT {a1} AND {b1} AND NOT {b2}))"


@query("polarity", f"""WITH p AS (SELECT p_partkey AS idx, p_size, lower({sql_list(_PHRASES)}[p_partkey % 8 + 1] || ' ' || p_name) AS q,
  lower({sql_list(_PHRASES)}[(p_partkey // 8) % 8 + 1] || ' ' || p_type) AS r FROM part)
SELECT idx, {_opposed_sql(*_POLARITY)} AS inverted, p_size % 2 = 1 AND {_opposed_sql(*_DIRECTION)} AS opposed FROM p""")
def polarity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    phrase = [F.element_at(X.words(_PHRASES), (i % 8 + 1).cast("int")) for i in (k, F.floor(k / 8))]
    q, r = F.concat(phrase[0], F.lit(" "), "p_name"), F.concat(phrase[1], F.lit(" "), "p_type")
    digits = F.when(F.col("p_size") % 2 == 1, "seat 7").otherwise("")
    return I.read(spark, d, "part").select(k.alias("idx"), X.polarity_inversion(q, r).alias("inverted"), X.opposing_direction(q, r, digits, F.lit("")).alias("opposed"))


@query("years", rf"""WITH {I.TITLES}, p AS (
  SELECT idx, title, ticker, idx % 4 AS m, 2025 + idx % 4 AS y, 2000 + CAST(regexp_extract(ticker, '-(\d{{2}})(?:[A-Z-]|$)', 1) AS INT) AS ty FROM titles)
SELECT idx, y >= {I.YEAR} AND abs(y - ty) > 1 AS conflict,
  CASE m WHEN 0 THEN y ELSE y - (m % 2) END AS effective_year FROM p""")
def years(spark: SparkSession, d: str) -> DataFrame:
    rows, m = I.titles(spark, d), F.col("idx") % 4
    deadline = F.when(m % 2 == 1, F.regexp_replace("title", " win in ", " win before ")).otherwise(F.col("title"))
    return rows.select("idx", X.ticker_year_conflict(F.col("title"), F.col("ticker"), I.YEAR).alias("conflict"), X.effective_year(deadline).cast("bigint").alias("effective_year"))


#: A title for each pattern, words in place of blanks and boundaries, and some that several rules or none fit; a ticker for each prefix.
_SPORT_TITLES = [re.sub(r"\\s\+?", "  ", p).replace(r"\b", "").upper() + " 7" for _, of in V.TITLE_SPORTS for p in of] + ["College basketball champion", "ICC T20 final", "World Cup cricket", "nothing here"]
_SPORT_TICKERS = [k + "-26" for k in V.TICKER_SPORTS] + ["kxuecl-2", "XX"]
_TITLE_CASES = " ".join(f"WHEN regexp_matches(lower(t), '{'|'.join(of)}') THEN '{sport}'" for sport, of in V.TITLE_SPORTS)
_TICKER_CASES = " ".join(f"WHEN starts_with(upper(k), '{p}') THEN '{sport}'" for p, sport in sorted(V.TICKER_SPORTS.items(), key=lambda x: -len(x[0])))


@query("sports", f"""WITH p AS (SELECT p_partkey AS idx, {sql_list(_SPORT_TITLES)}[p_partkey % {len(_SPORT_TITLES)} + 1] AS t, {sql_list(_SPORT_TICKERS)}[(p_partkey // 8) % {len(_SPORT_TICKERS)} + 1] AS k FROM part),
 s AS (SELECT idx, CASE {_TITLE_CASES} END AS a_sport, CASE {_TICKER_CASES} END AS b_sport FROM p)
SELECT idx, a_sport, b_sport, coalesce(a_sport <> b_sport, false) AS differ FROM s""")
def sports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.element_at(X.words(_SPORT_TITLES), (k % len(_SPORT_TITLES) + 1).cast("int"))
    ticker = F.element_at(X.words(_SPORT_TICKERS), (F.floor(k / 8) % len(_SPORT_TICKERS) + 1).cast("int"))
    return I.read(spark, d, "part").select(k.alias("idx"), X.title_sport(title).alias("a_sport"), X.ticker_sport(ticker).alias("b_sport"), X.sports_differ(title, ticker).alias("differ"))


@query("placeholders", r"""
SELECT p_partkey AS idx, regexp_matches(e, '^(?:(?:person|candidate|player|artist|team|placeholder)\s+[a-z0-9]{1,3}|another\s+candidate|another\s+player|other)$') AS s1,
  regexp_matches(e, '^(?:(?:person|candidate|player|artist|team|placeholder)\s+[a-z0-9]{1,3}|another\s+candidate|other)$') AS s3
FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'player ' || CAST(p_size AS VARCHAR) WHEN 1 THEN 'another player' WHEN 2 THEN 'other' WHEN 3 THEN 'candidate abcd' ELSE p_name END AS e FROM part)""")
def placeholders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    e = F.when(k % 5 == 0, F.concat(F.lit("player "), F.col("p_size").cast("string"))).when(k % 5 == 1, "another player").when(k % 5 == 2, "other").when(k % 5 == 3, "candidate abcd").otherwise(F.col("p_name"))
    return I.read(spark, d, "part").select(k.alias("idx"), *(X.is_placeholder(e, s).alias(s.lower()) for s in ("S1", "S3")))


# ---- merge, dates and reports ----


@query("union_dedup", f"""WITH {I.SCORED} SELECT strategy, b_ticker, a_entity, score, idx FROM (
  SELECT *, row_number() OVER (PARTITION BY b_ticker, coalesce(a_entity, '') ORDER BY score DESC, strategy, idx) AS nth FROM scored) WHERE nth = 1""")
def union_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = I.scored(spark, d)  # one scan of all strategies' pairs; files of single strategies come by ``merge.union_all``
    return merge.dedup_pairs(merge.union_all([rows]), ["strategy", "idx"])


@query("score_bands", f"WITH {I.SCORED} SELECT count(*) FILTER (score = 1) AS exact, count(*) FILTER (score >= 0.75 AND score < 1) AS high, count(*) FILTER (score >= 0.5 AND score < 0.75) AS low FROM scored")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return merge.score_bands(I.scored(spark, d))


@query("score_stats", f"WITH {I.SCORED} SELECT strategy, count(*) AS n, round(avg(score), 6) AS mean_score, min(score) AS min_score, median(score) AS median_score FROM scored GROUP BY 1")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return merge.score_stats(I.scored(spark, d), "strategy").withColumn("mean_score", F.round("mean_score", 6))


@query("resolution_dates", f"WITH {I.DATED} SELECT idx, strftime(resolution_date, '%Y-%m-%dT%H:%M:%S.000Z') AS resolution_date, days_to_resolution, date_capped FROM resolved")
def resolution_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = merge.with_dates(I.dated(spark, d), F.lit(I.AS_OF).cast("timestamp"))
    return rows.select("idx", iso_millis(F.col("resolution_date")).alias("resolution_date"), "days_to_resolution", "date_capped")


@query("day_bands", f"""WITH {I.DATED} SELECT count(*) FILTER (NOT date_capped AND days_to_resolution < 7) AS below_7, count(*) FILTER (NOT date_capped AND days_to_resolution >= 7 AND days_to_resolution < 30) AS below_30,
  count(*) FILTER (NOT date_capped AND days_to_resolution >= 30 AND days_to_resolution < 90) AS below_90, count(*) FILTER (NOT date_capped AND days_to_resolution >= 90 AND days_to_resolution < 180) AS below_180,
  count(*) FILTER (NOT date_capped AND days_to_resolution >= 180 AND days_to_resolution < 365) AS below_365, median(days_to_resolution) FILTER (NOT date_capped) AS median_days,
  count(*) FILTER (days_to_resolution IS NULL) AS missing, count(*) FILTER (date_capped) AS capped FROM resolved""")
def day_bands(spark: SparkSession, d: str) -> DataFrame:
    return merge.day_bands(merge.with_dates(I.dated(spark, d), F.lit(I.AS_OF).cast("timestamp")))


@query("verdicts", """
SELECT o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'REJECT' WHEN 3 THEN 'MATCH' ELSE 'REJECT' END AS verdict FROM orders""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.when(k % 5 == 0, '```json\n{"verdict": "MATCH", "a_identified": "x", "b_identified": "x"}\n```').when(k % 5 == 1, '{"verdict": "MATCH", "a_identified": "x", "b_identified": "Unknown"}').when(k % 5 == 2, "no json").when(k % 5 == 3, '{"verdict": "MATCH"}').otherwise('{"reason": "none"}')
    return I.read(spark, d, "orders").select(k.alias("idx"), merge.verdict_of(body)["verdict"].alias("verdict"))


@query("verified", f"""WITH {I.SCORED} SELECT idx, score FROM scored WHERE score >= 0.75 OR (idx % 3 = 0 AND idx % 9 <> 0)""")
def verified(spark: SparkSession, d: str) -> DataFrame:
    rows = I.scored(spark, d).withColumn("pair_key", F.col("idx").cast("string"))
    said = rows.where("idx % 6 <> 1").select("pair_key", F.when(F.col("idx") % 3 == 0, "MATCH").otherwise("REJECT").alias("verdict"), F.lit("x").alias("a_identified"), F.when(F.col("idx") % 9 == 0, "unknown").otherwise("x").alias("b_identified"))
    return merge.verified(rows, said).select("idx", "score")


@query("manifest_filter", f"""WITH {I.DATED} SELECT coalesce(CASE WHEN idx % 13 = 0 THEN 'spread' WHEN idx % 17 = 0 THEN 'more_markets' WHEN days_to_resolution IS NULL THEN 'no_date' WHEN days_to_resolution < 1 THEN 'too_soon' END, 'kept') AS reason,
  count(*) AS n FROM resolved GROUP BY 1""")
def manifest_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = merge.with_dates(I.dated(spark, d), F.lit(I.AS_OF).cast("timestamp"))
    rows = rows.withColumn("a_question", F.when(F.col("idx") % 13 == 0, "Spread: x").when(F.col("idx") % 17 == 0, "x More Markets"))
    return rows.groupBy(F.coalesce(merge.drop_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# ---- pricing ----

_FEE = "CASE WHEN {p} <= 0 OR {p} >= 1 OR {c} <= 0 THEN 0.0::DOUBLE ELSE ceil(0.07::DOUBLE * {c} * {p} * (1.0::DOUBLE - {p}) * 100) / 100.0::DOUBLE END"
_VWAP = f"""{I.LEVELS}, priced AS (SELECT market, side, size::DOUBLE AS size, tick / 100.0::DOUBLE AS price FROM levels WHERE tick > 0 AND tick < 100
), walked AS (
  SELECT *, 50.0::DOUBLE - coalesce(sum(price * size) OVER (PARTITION BY market, side ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rest FROM priced
), taken AS (SELECT *, least(size, rest / price) AS take FROM walked WHERE rest > 0
), vwaps AS (SELECT market, side, sum(take * price ORDER BY price) / sum(take ORDER BY price) AS vwap, count(*) AS levels FROM taken GROUP BY 1, 2
), legs AS (SELECT a.market, a.vwap AS a_vwap, b.vwap AS b_vwap, a.levels AS a_levels, b.levels AS b_levels FROM vwaps a JOIN vwaps b ON a.market = b.market AND a.side = 'a' AND b.side = 'b'
), costs AS (SELECT *, a_vwap * (1.0::DOUBLE + 0.0::DOUBLE) + b_vwap * (1.0::DOUBLE + ({_FEE.format(p='b_vwap', c='(50.0::DOUBLE / b_vwap)')}) / ((50.0::DOUBLE / b_vwap) * b_vwap)) AS cost FROM legs
), classed AS (SELECT *, CASE WHEN cost >= 1 THEN 'loss' WHEN 1 - cost > 0.15 THEN 'suspect' ELSE 'candidate' END AS verdict, (market * 7 % 400)::DOUBLE AS days, market % 9 = 0 AS capped FROM costs)"""


def _vwaps(spark: SparkSession, d: str) -> DataFrame:
    levels = I.level_rows(spark, d).withColumn("price", F.col("tick") / 100.0)
    return books.vwap(levels, "market", "side", target=T.target)


def _legs(spark: SparkSession, d: str) -> DataFrame:
    v = _vwaps(spark, d)
    sides = [v.where(F.col("side") == s).select("market", F.col("vwap").alias(f"{s}_vwap"), F.col("levels").alias(f"{s}_levels")) for s in ("a", "b")]
    legs = sides[0].join(sides[1], "market").withColumn("cost", P.round_trip_cost(F.col("a_vwap"), F.col("b_vwap")))
    return legs.withColumns({"verdict": P.verdict(F.col("cost")), "days": (F.col("market") * 7 % 400).cast("double"), "capped": F.col("market") % 9 == 0})


@query("vwap", f"WITH {_VWAP} SELECT market, side, round(vwap, 6) AS vwap, levels FROM vwaps")
def vwap(spark: SparkSession, d: str) -> DataFrame:
    return _vwaps(spark, d).select("market", "side", F.round("vwap", 6).alias("vwap"), "levels")


@query("ask_book", f"""WITH {I.LEVELS} SELECT market, round_even(1.0::DOUBLE - tick / 100.0::DOUBLE, 4) AS price, size FROM levels WHERE side = 'b' AND tick > 0 AND tick < 100""")
def ask_book(spark: SparkSession, d: str) -> DataFrame:
    bids = I.level_rows(spark, d).where("side = 'b'").withColumn("price", F.col("tick") / 100.0)
    return books.complement(bids, "market").select("market", "price", "size")


@query("fees", f"""SELECT l_orderkey, l_linenumber, {_FEE.format(p='p', c='c')} AS fee, CASE WHEN p <= 0 OR p >= 1 THEN 0.0::DOUBLE ELSE 0.07::DOUBLE * (1.0::DOUBLE - p) END AS rate
FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 101) / 100.0::DOUBLE AS p, l_quantity AS c FROM lineitem)""")
def fees(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_orderkey") % 101 / 100.0
    return I.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.total_fee(p, F.col("l_quantity")).alias("fee"), P.fee_rate(p).alias("rate"))


@query("round_trip", f"WITH {_VWAP} SELECT market, round(a_vwap, 6) AS a_vwap, round(b_vwap, 6) AS b_vwap, round(cost, 6) AS cost, verdict FROM classed")
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _legs(spark, d).select("market", *(F.round(c, 6).alias(c) for c in ("a_vwap", "b_vwap", "cost")), "verdict")


@query("time_value", """SELECT o_orderkey AS idx, CASE WHEN days IS NULL THEN 'no_resolution_date' WHEN days < 1 THEN 'resolves_too_soon' WHEN profit < need THEN 'below_risk_free' ELSE 'pass' END AS reason,
  CASE WHEN days IS NULL OR days < 1 THEN 0.0::DOUBLE ELSE round(need, 9) END AS required
FROM (SELECT *, 0.04::DOUBLE * (CASE WHEN capped THEN greatest(days, 1095.0::DOUBLE) ELSE days END / 365.0::DOUBLE) AS need FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey % 400)::DOUBLE END AS days, o_orderkey % 7 = 0 AS capped, (o_orderkey % 150) / 1000.0::DOUBLE AS profit FROM orders))""")
def time_value(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = P.time_value(k % 150 / 1000.0, F.when(k % 10 != 0, (k % 400).cast("double")), k % 7 == 0)
    return I.read(spark, d, "orders").select(k.alias("idx"), x.alias("x")).select("idx", "x.reason", F.round("x.required", 9).alias("required"))


@query("arbitrage", f"""WITH {_VWAP}, depths AS (SELECT market, count(*) FILTER (side = 'a') AS a_depth, count(*) FILTER (side = 'b') AS b_depth FROM levels GROUP BY 1)
SELECT market, round(cost, 6) AS cost, round(1 - cost, 6) AS profit FROM classed JOIN depths USING (market)
WHERE verdict = 'candidate' AND a_depth >= 2 AND b_depth >= 2 AND days >= 1
  AND 1 - cost >= 0.04::DOUBLE * (CASE WHEN capped THEN greatest(days, 1095.0::DOUBLE) ELSE days END / 365.0::DOUBLE)""")
def arbitrage(spark: SparkSession, d: str) -> DataFrame:
    deep = books.depth(I.level_rows(spark, d), "market", "side").where(F.col("depth") >= T.levels).groupBy("market").count().where("count = 2").select("market")
    rows = _legs(spark, d).where("verdict = 'candidate'").join(deep, "market").withColumn("profit", F.lit(1.0) - F.col("cost"))
    ok = P.time_value(F.col("profit"), F.col("days"), F.col("capped"))["ok"]
    return rows.where(ok).select("market", F.round("cost", 6).alias("cost"), F.round("profit", 6).alias("profit"))


_LEDGER = "substring(repeat('{} ' || CAST(market AS VARCHAR) || ' ', 20), 1, 80)"


@query("ledger", f"""WITH {_VWAP} SELECT '1998-01-01T00:00:00.000Z' AS timestamp, {_LEDGER.format('event')} AS a_event_title, {_LEDGER.format('match')} AS b_event_title, 'q' || CAST(market AS VARCHAR) AS a_question,
  CAST(market AS VARCHAR) AS b_ticker, CASE WHEN market % 2 = 0 THEN 'a_yes_b_no' ELSE 'a_no_b_yes' END AS direction, printf('%.4f', round_even(a_vwap, 4)) AS a_vwap, printf('%.4f', round_even(b_vwap, 4)) AS b_vwap,
  printf('%.4f', round_even(cost, 4)) AS total_cost, printf('%.4f', round_even(1 - cost, 4)) AS projected_profit, '50.00' AS capital_deployed,
  CAST(market * 3 AS VARCHAR) AS a_staleness_ms, CAST(market * 5 AS VARCHAR) AS b_staleness_ms, printf('%.2f', round_even(days, 2)) AS days_to_resolution,
  printf('%.4f', round_even(0.04::DOUBLE * (CASE WHEN capped THEN greatest(days, 1095.0::DOUBLE) ELSE days END / 365.0::DOUBLE), 4)) AS required_return_for_period,
  printf('%.4f', round_even(CASE WHEN days > 0 THEN (1 - cost) * (365.0::DOUBLE / days) ELSE 0 END, 4)) AS annualized_return, '2026-11-' || lpad(CAST(market % 30 + 1 AS VARCHAR), 2, '0') AS resolution_date,
  '0.0000' AS a_fee_pct, printf('%.4f', round_even(({_FEE.format(p='b_vwap', c='(50.0::DOUBLE / b_vwap)')}) / ((50.0::DOUBLE / b_vwap) * b_vwap), 4)) AS b_fee_pct FROM classed WHERE days >= 1""")
def ledger(spark: SparkSession, d: str) -> DataFrame:
    m, days = F.col("market"), F.col("days")
    required = P.time_value(F.lit(1.0), days, F.col("capped"))["required"]
    rows = _legs(spark, d).where(days >= 1).withColumns({
        "at": F.lit(I.AS_OF).cast("timestamp"), "a_event_title": F.repeat(F.concat(F.lit("event "), m.cast("string"), F.lit(" ")), 20), "b_event_title": F.repeat(F.concat(F.lit("match "), m.cast("string"), F.lit(" ")), 20),
        "a_question": F.concat(F.lit("q"), m.cast("string")), "b_ticker": m.cast("string"), "direction": F.when(m % 2 == 0, "a_yes_b_no").otherwise("a_no_b_yes"),
        "total_cost": F.col("cost"), "profit": F.lit(1.0) - F.col("cost"), "a_staleness_ms": m * 3, "b_staleness_ms": m * 5, "days_to_resolution": days, "required": required,
        "resolution_date": F.concat(F.lit("2026-11-"), F.lpad((m % 30 + 1).cast("string"), 2, "0")),
    })
    return signals.ledger(rows)


# ---- books and signals ----

_EPOCHS = f"""{I.MESSAGES}, marked AS (SELECT *, sum(CASE WHEN kind = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY seq) AS epoch FROM messages)"""
_DELTAS = f"""{_EPOCHS}, sums AS (SELECT *, sum(qty) OVER w AS s FROM marked WINDOW w AS (PARTITION BY book, side, tick, epoch ORDER BY seq)
), sizes AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY book, side, tick, epoch ORDER BY seq)) AS size FROM sums)"""
_ABSOLUTE = f"""{I.MESSAGES}, since AS (SELECT book, max(seq) FILTER (kind = 'snapshot') AS since FROM messages WHERE kind <> 'delta' GROUP BY 1
), state AS (SELECT book, side, tick, arg_max(qty, seq) AS size FROM messages JOIN since USING (book) WHERE kind <> 'delta' AND (since IS NULL OR seq >= since) GROUP BY 1, 2, 3 HAVING arg_max(qty, seq) > 0)"""


@query("book_absolute", f"WITH {_ABSOLUTE} SELECT book, side, tick, size FROM state")
def book_absolute(spark: SparkSession, d: str) -> DataFrame:
    return books.absolute_state(I.messages(spark, d).where("kind <> 'delta'")).select("book", "side", "tick", "size")


@query("book_delta", f"WITH {_DELTAS} SELECT book, seq, CAST(size AS BIGINT) AS size FROM sizes")
def book_delta(spark: SparkSession, d: str) -> DataFrame:
    return books.delta_sizes(I.messages(spark, d)).select("book", "seq", "size")


@query("book_delta_pieces", f"WITH {_DELTAS} SELECT book, seq, CAST(size AS BIGINT) AS size FROM sizes")
def book_delta_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The same, as hot books are replayed."""
    return books.sizes_in_pieces(I.messages(spark, d).withColumn("kind", F.when(F.col("kind") == "snapshot", "snapshot").otherwise("delta"))).select("book", "seq", "size")


@query("book_delta_state", f"""WITH {_DELTAS}, newest AS (SELECT book, max(epoch) AS epoch FROM sizes GROUP BY 1)
SELECT book, side, tick, CAST(arg_max(size, seq) AS BIGINT) AS size FROM sizes JOIN newest USING (book, epoch) GROUP BY 1, 2, 3 HAVING arg_max(size, seq) > 0""")
def book_delta_state(spark: SparkSession, d: str) -> DataFrame:
    return books.delta_state(I.messages(spark, d))


@query("book_best", f"WITH {_ABSOLUTE} SELECT book, max(tick) AS best, count(*) AS depth FROM state WHERE side = 'bid' GROUP BY 1")
def book_best(spark: SparkSession, d: str) -> DataFrame:
    return books.best(books.absolute_state(I.messages(spark, d).where("kind <> 'delta'")))


@query("book_as_of", f"""WITH {I.MESSAGES}, marks AS (SELECT user_id AS book, event_id AS "at" FROM events WHERE event_id % 20 = 0
), since AS (SELECT m.book, m."at", max(x.seq) FILTER (x.kind = 'snapshot') AS since FROM marks m LEFT JOIN messages x ON x.book = m.book AND x.seq <= m."at" AND x.kind <> 'delta' GROUP BY 1, 2
), levels AS (SELECT s.book, s."at", x.side, x.tick, arg_max(x.qty, x.seq) AS size FROM since s JOIN messages x ON x.book = s.book AND x.seq <= s."at" AND x.kind <> 'delta' AND (s.since IS NULL OR x.seq >= s.since) GROUP BY 1, 2, 3, 4)
SELECT book, "at", coalesce(max(tick) FILTER (side = 'bid'), -1) AS best_bid, count(*) FILTER (side = 'bid') AS bids, coalesce(min(tick) FILTER (side = 'ask'), -1) AS best_ask, count(*) FILTER (side = 'ask') AS asks
FROM marks LEFT JOIN (SELECT * FROM levels WHERE size > 0) USING (book, "at") GROUP BY 1, 2""")
def book_as_of(spark: SparkSession, d: str) -> DataFrame:
    log = I.messages(spark, d)
    found = books.as_of(log.where("kind <> 'delta'"), log.where("seq % 20 = 0").select("book", F.col("seq").alias("at")))
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("best_bid", "best_ask")})


@query("oversum", f"""WITH {_ABSOLUTE}, best AS (SELECT book, max(tick) / 5.0::DOUBLE AS price FROM state WHERE side = 'bid' GROUP BY 1), markets AS (SELECT DISTINCT user_id AS book, user_id // 4 AS event FROM events)
SELECT CAST(event AS VARCHAR) AS event, count(*) AS n_markets, count(price) AS counted, count(*) >= 3 AND count(price) >= 3 AND coalesce(sum(price), 0) > 1.05::DOUBLE AS is_oversum FROM markets LEFT JOIN best USING (book) GROUP BY 1""")
def oversum(spark: SparkSession, d: str) -> DataFrame:
    log = I.messages(spark, d)
    best = books.best(books.absolute_state(log.where("kind <> 'delta'"))).select("book", (F.col("best") / 5.0).alias("price"))
    markets = log.select(F.floor(F.col("book") / 4).cast("string").alias("event"), "book")
    return books.oversum(best, markets, T.oversum, T.oversum_markets).drop("total")


@query("oversum_timeline", f"""WITH {I.MESSAGES}, log AS (SELECT *, sum(CASE WHEN kind = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY seq) AS epoch FROM messages WHERE kind <> 'delta'
), sizes AS (SELECT book, seq, t, last_value(CASE WHEN side = 'bid' AND tick = t AND NOT (kind = 'snapshot' AND qty <= 0) THEN qty END IGNORE NULLS) OVER (PARTITION BY book, epoch, t ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size
  FROM log, (SELECT unnest([1, 2, 3, 4, 5]) AS t)
), best AS (SELECT book, seq, max(t) FILTER (size > 0) AS best FROM sizes GROUP BY 1, 2
), steps AS (SELECT *, lag(best) OVER (PARTITION BY book ORDER BY seq) AS before FROM best
), changes AS (SELECT book // 4 AS event, seq, coalesce(best, 0) - coalesce(before, 0) AS total, CAST(best IS NOT NULL AS INT) - CAST(before IS NOT NULL AS INT) AS counted FROM steps WHERE best IS DISTINCT FROM before
), summed AS (SELECT event, seq, sum(total) OVER w AS total, sum(counted) OVER w AS counted FROM changes WINDOW w AS (PARTITION BY event ORDER BY seq)
), markets AS (SELECT user_id // 4 AS event, count(DISTINCT user_id) AS n_markets FROM events GROUP BY 1)
SELECT CAST(event AS VARCHAR) AS event, seq, CAST(total AS BIGINT) AS total, CAST(counted AS BIGINT) AS counted, n_markets >= 3 AND counted >= 3 AND total > 5.25::DOUBLE AS is_oversum FROM summed JOIN markets USING (event)""")
def oversum_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The over-sum of each event after each message that changes a best bid, prices in fifths."""
    log = I.messages(spark, d)
    markets = log.select(F.floor(F.col("book") / 4).cast("string").alias("event"), "book")
    return books.oversum_changes(log.where("kind <> 'delta'"), markets, 5 * T.oversum, T.oversum_markets).drop("item")


@query("active_books", f"""WITH {I.MESSAGES}, known AS (SELECT DISTINCT user_id AS book FROM events UNION SELECT user_id + 100000 FROM events)
SELECT count(*) AS n_books, count(*) FILTER (book IN (SELECT book FROM messages)) AS n_active FROM known""")
def active_books(spark: SparkSession, d: str) -> DataFrame:
    log = I.messages(spark, d)
    return books.active(log.select("book").union(log.select(F.col("book") + 100_000)), log)


_PAIRS = f"""{I.MESSAGES}, pairs AS (SELECT DISTINCT user_id AS pair, user_id AS a_book, user_id + 1 AS b_book FROM events),
 legs AS (SELECT a_book AS book, pair, 'a' AS leg FROM pairs UNION ALL SELECT b_book, pair, 'b' FROM pairs),
 touched AS (SELECT m.*, pair, leg FROM messages m JOIN legs USING (book)),
 seen AS (SELECT *, last_value(CASE WHEN leg = 'a' THEN recv_ts END IGNORE NULLS) OVER w AS a_ts, last_value(CASE WHEN leg = 'b' THEN recv_ts END IGNORE NULLS) OVER w AS b_ts FROM touched
   WINDOW w AS (PARTITION BY pair ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 aged AS (SELECT *, epoch_us(recv_ts) // 1000 - epoch_us(a_ts) // 1000 AS a_ms, epoch_us(recv_ts) // 1000 - epoch_us(b_ts) // 1000 AS b_ms FROM seen)"""
STALE_MS, COOLDOWN_MS = 6 * 3_600_000, 24 * 3_600_000


def _aged(spark: SparkSession, d: str) -> DataFrame:
    log = I.messages(spark, d)
    pairs = log.select(F.col("book").alias("pair"), F.col("book").alias("a_book"), (F.col("book") + 1).alias("b_book")).distinct()
    return signals.ages(signals.latest(signals.fan_out(log, pairs)))


@query("fan_out", f"WITH {_PAIRS} SELECT pair, leg, count(*) AS n FROM touched GROUP BY 1, 2")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    return _aged(spark, d).groupBy("pair", "leg").agg(F.count("*").alias("n"))


@query("as_of", f"WITH {_PAIRS} SELECT pair, seq, coalesce(a_ms, -1) AS a_ms, coalesce(b_ms, -1) AS b_ms FROM aged")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    return _aged(spark, d).select("pair", "seq", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("a_ms", "b_ms")))


def _outcome() -> Column:
    stale = (F.col("a_ms") > STALE_MS) | (F.col("b_ms") > STALE_MS)
    return F.when(F.col("a_ts").isNull() | F.col("b_ts").isNull(), "unseen").when(stale, "stale").when(F.col("qty") <= 0, "thin").otherwise("signal")


@query("cooldown", f"""WITH {_PAIRS}, s AS (SELECT pair, list([epoch_us(recv_ts) // 1000] ORDER BY recv_ts) AS c FROM aged WHERE a_ts IS NOT NULL AND b_ts IS NOT NULL AND a_ms <= {STALE_MS} AND b_ms <= {STALE_MS} AND qty > 0 GROUP BY 1)
SELECT pair, unnest(list_reduce(c, lambda acc, x: CASE WHEN x[1] - acc[len(acc)] < {COOLDOWN_MS} THEN acc ELSE list_concat(acc, x) END)) AS at FROM s""")
def cooldown(spark: SparkSession, d: str) -> DataFrame:
    return signals.cooled(_signals(spark, d), COOLDOWN_MS, most=2 * _most(I.messages(spark, d)))  # a pair has two books


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return _aged(spark, d).where(_outcome() == "signal").select("pair", F.unix_millis("recv_ts").alias("at"))


def _most(log: DataFrame) -> int:
    """The messages of the book that has most."""
    return log.groupBy("book").count().agg(F.max("count").alias("n")).head().n or 0


@query("cooldown_doubling", ORACLE_SQL["cooldown"])
def cooldown_doubling(spark: SparkSession, d: str) -> DataFrame:
    """The same, as hot pairs are followed."""
    return signals.cooled_by_doubling(_signals(spark, d), COOLDOWN_MS)


# ---- whole pipelines ----


def _landed(rows: DataFrame, day: str) -> list[DataFrame]:
    """Landed JSON of both venues' events, made of ``rows(event, side, idx, title, ticker)``."""
    rows = rows.withColumn("question", F.col("title"))
    a_market = F.struct("question", F.lit(False).alias("closed"), F.lit(True).alias("active"), F.to_json(F.array(F.concat(F.lit("y"), "idx"), F.concat(F.lit("n"), "idx"))).alias("clobTokenIds"), F.lit(day).alias("endDate"))
    b_market = F.struct("ticker", "title", F.lit("active").alias("status"), F.lit(day).alias("expiration_time"))
    return [rows.where(F.col("side") == k).groupBy("event").agg(F.sort_array(F.collect_list(F.struct("idx", m.alias("m")))).alias("ms")).select(F.col("event").alias("event_id"), F.to_json(F.struct(F.col("ms.m").alias("markets"))).alias("body")) for k, m in (("a", a_market), ("b", b_market))]


def _matches(rows: DataFrame, category: str, title: Column) -> DataFrame:
    return rows.select(F.lit(category).alias("category"), F.col("event").alias("a_event_id"), title.alias("a_event_title"), F.col("event").alias("b_event_ticker"), F.col("event").alias("b_event_title")).distinct().withColumn("ordinal", F.xxhash64("a_event_id"))


_DAY = "2026-11-03T00:00:00Z"


@query("manifest", f"""WITH {_pairs_sql('S2')}, {_FOLDED}
SELECT folded.event AS b_event_ticker, a.title AS a_question, b.ticker AS b_ticker, round_even(e.s, 3) AS score, 306.0::DOUBLE AS days_to_resolution, false AS date_capped
FROM folded JOIN titles a ON a.idx = e.a JOIN titles b ON b.idx = e.b WHERE e.s >= 0.75 AND NOT {_CONFLICT}""")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Strategy S2 over landed JSON made from ``part``, then the manifest."""
    from gridloom.plans.resolve import build_manifest, resolve

    rows = I.titles(spark, d)
    pairs = resolve(_matches(rows, "Sports", F.concat("event", F.lit(" vs all"))), *_landed(rows, _DAY), "S2", I.YEAR).pairs
    none = pairs.select(F.lit("").alias("pair_key"), *(F.lit("").alias(c) for c in ("verdict", "reason", "a_identified", "b_identified"))).limit(0)
    out = build_manifest([pairs], none, F.lit("2026-01-01").cast("timestamp"))
    return out.select("b_event_ticker", "a_question", "b_ticker", "score", "days_to_resolution", "date_capped")


def _resolve_query(s: str, category: str, title: str) -> None:
    """All pairs of one strategy, whose event matches are found by ``category`` and, for S3, by a title that is no head-to-head."""

    @query(f"resolve_{s.lower()}", f"""WITH {_pairs_sql(s)}, {_FOLDED}
SELECT folded.event AS b_event_ticker, a.title AS a_question, b.ticker AS b_ticker, a.entity AS a_entity, b.entity AS b_entity, round_even(e.s, 3) AS score, 'entity_match' AS alignment_type
FROM folded JOIN entities a ON a.idx = e.a JOIN entities b ON b.idx = e.b WHERE NOT {_CONFLICT}""")
    def resolved(spark: SparkSession, d: str) -> DataFrame:
        from gridloom.plans.resolve import resolve

        rows = I.titles(spark, d)
        other = _matches(rows, category, F.concat("event", F.lit(title))).unionByName(_matches(rows, "Other", F.lit("of no strategy")))
        return resolve(other, *_landed(rows, _DAY), s, I.YEAR).pairs.select("b_event_ticker", "a_question", "b_ticker", "a_entity", "b_entity", "score", "alignment_type")


for _s, _category, _title in (("S1", "Elections", " poll"), ("S3", "Sports", " award"), ("S5", "Companies", " earnings")):
    _resolve_query(_s, _category, _title)


_S1_PAIRS = f"""{_pairs_sql("S1")}, {_FOLDED}, found AS (SELECT folded.event, a.title AS a_title, b.title AS b_title, a.entity AS x, b.entity AS y, round_even(e.s, 3) AS score
  FROM folded JOIN entities a ON a.idx = e.a JOIN entities b ON b.idx = e.b WHERE NOT {_CONFLICT}
), matched AS (SELECT DISTINCT event FROM titles), none AS (SELECT event, CASE WHEN NOT bool_or(side = 'a') THEN 'a_fetch' WHEN NOT bool_or(side = 'b') THEN 'b_fetch' ELSE 'alignment' END AS stage FROM titles WHERE event NOT IN (SELECT event FROM found) GROUP BY 1)"""


def _resolved_s1(spark: SparkSession, d: str) -> tuple:
    from gridloom.plans.resolve import resolve

    rows = I.titles(spark, d)
    matches = _matches(rows, "Elections", F.concat("event", F.lit(" poll")))
    return matches, resolve(matches, *_landed(rows, _DAY), "S1", I.YEAR)


@query("resolver_report", f"""WITH {_S1_PAIRS}
SELECT 'total' AS section, 'events' AS item, count(*)::DOUBLE AS value FROM matched UNION ALL SELECT 'total', 'pairs', count(*) FROM found HAVING count(*) > 0 UNION ALL SELECT 'total', 'errors', count(*) FROM none HAVING count(*) > 0
UNION ALL SELECT 'error', stage, count(*) FROM none GROUP BY 2 UNION ALL SELECT 'alignment', 'entity_match', count(*) FROM found HAVING count(*) > 0 UNION ALL SELECT 'category', 'Elections', count(*) FROM found HAVING count(*) > 0
UNION ALL SELECT 'entities', CASE WHEN x = y THEN 'equal' ELSE 'different' END, count(*) FROM found GROUP BY 2
UNION ALL SELECT 'score', 'mean', round_even(avg(score), 3) FROM found UNION ALL SELECT 'score', 'least', min(score) FROM found UNION ALL SELECT 'score', 'median', median(score) FROM found""")
def resolver_report(spark: SparkSession, d: str) -> DataFrame:
    """What a resolver's run gave."""
    matches, found = _resolved_s1(spark, d)
    return merge.resolver_report(matches, found.pairs, found.errors)


@query("inspections", f"WITH {_S1_PAIRS} SELECT score, x AS a_entity, y AS b_entity, substring(a_title, 1, 65) AS a_question, substring(b_title, 1, 65) AS b_title FROM found WHERE x <> y")
def inspections(spark: SparkSession, d: str) -> DataFrame:
    """Matches of unequal entities."""
    return merge.inspections(_resolved_s1(spark, d)[1].pairs)


@query("resolve_s4", f"""WITH {I.BRACKETS}, sided AS (SELECT event, side, count(*) FILTER (idx % 7 <> 6) * 10 > count(*) * 3 AS is_numeric FROM brackets GROUP BY 1, 2
), numeric AS (SELECT event FROM sided GROUP BY 1 HAVING count(*) = 2 AND bool_and(is_numeric)
), b AS (SELECT *, CASE WHEN idx % 3 <> 1 THEN p_size END AS lo, CASE WHEN idx % 3 = 0 THEN p_size + 5 WHEN idx % 3 = 1 THEN p_size END AS hi FROM brackets WHERE idx % 7 <> 6
), met AS (SELECT x.event, x.idx AS a_idx, min(y.idx) AS b_idx, '(' || coalesce(CAST(x.lo AS VARCHAR) || '.0', 'None') || ', ' || coalesce(CAST(x.hi AS VARCHAR) || '.0', 'None') || ')' AS entity
  FROM b x JOIN b y ON x.event = y.event AND x.side = 'a' AND y.side = 'b' AND x.lo IS NOT DISTINCT FROM y.lo AND x.hi IS NOT DISTINCT FROM y.hi JOIN numeric ON numeric.event = x.event GROUP BY x.event, x.idx, x.lo, x.hi
), ranked AS (SELECT *, row_number() OVER (PARTITION BY b_idx, entity ORDER BY 'y' || CAST(a_idx AS VARCHAR)) AS nth FROM met)
SELECT r.event AS b_event_ticker, a.title AS a_question, 'K' || CAST(r.b_idx AS VARCHAR) AS b_ticker, r.entity AS a_entity, 1.0::DOUBLE AS score, 'exact_boundary' AS alignment_type FROM ranked r JOIN brackets a ON a.idx = r.a_idx WHERE nth = 1""")
def resolve_s4(spark: SparkSession, d: str) -> DataFrame:
    """The numeric route: brackets of both venues that have the same bounds."""
    from gridloom.plans.resolve import resolve

    rows = I.brackets(spark, d).withColumns({"ticker": F.concat(F.lit("K"), F.col("idx").cast("string"))})
    found = resolve(_matches(rows, "Economics", F.concat("event", F.lit(" rate"))), *_landed(rows, _DAY), "S4", I.YEAR).pairs
    return found.where("alignment_type = 'exact_boundary'").select("b_event_ticker", "a_question", "b_ticker", "a_entity", "score", "alignment_type")


@query("resolve_errors", f"""WITH {_pairs_sql('S2')}, {_FOLDED}, paired AS (SELECT DISTINCT folded.event FROM folded JOIN titles a ON a.idx = e.a JOIN titles b ON b.idx = e.b WHERE NOT {_CONFLICT}),
 sides AS (SELECT event, bool_or(side = 'a') AND length(event) % 2 = 0 AS has_a, bool_or(side = 'b') AS has_b FROM titles GROUP BY 1)
SELECT event AS a_event_id, CASE WHEN NOT has_a THEN 'a_fetch' WHEN NOT has_b THEN 'b_fetch' ELSE 'alignment' END AS stage, CASE WHEN has_a AND has_b THEN 'no pairs' ELSE 'not landed' END AS error
FROM sides WHERE NOT has_a OR NOT has_b OR event NOT IN (SELECT event FROM paired)""")
def resolve_errors(spark: SparkSession, d: str) -> DataFrame:
    """The error side: events that were not landed, and those that gave no pairs."""
    from gridloom.plans.resolve import resolve

    rows = I.titles(spark, d)
    a, b = _landed(rows, _DAY)
    found = resolve(_matches(rows, "Sports", F.concat("event", F.lit(" vs all"))), a.where(F.length("event_id") % 2 == 0), b, "S2", I.YEAR)
    return found.errors.select("a_event_id", "stage", "error")


# ---- files ----


@query("files_of_pairs", f"""WITH {I.SCORED} SELECT strategy, 'y' || CAST(idx AS VARCHAR) AS a_yes_token, 'q "' || CAST(idx AS VARCHAR) || '", z' || chr(10) || 'é' AS a_question, b_ticker, coalesce(a_entity, '') AS a_entity, score FROM scored WHERE strategy <> 'S4'""")
def files_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The strategies' pairs written as CSV files and read again, quotes and line breaks included; the file of one is not there."""
    from gridloom.sources import files, schemas, tables

    rows = I.scored(spark, d)
    k = F.col("idx").cast("string")
    made = {"a_yes_token": F.concat(F.lit("y"), k), "a_no_token": F.concat(F.lit("n"), k), "a_question": F.concat(F.lit('q "'), k, F.lit('", z\né')), "b_ticker": F.col("b_ticker"), "score": F.col("score"), "a_entity": F.col("a_entity")}
    columns = [x.split()[0] for x in schemas.PAIRS.split(", ")]
    pairs = rows.select("strategy", *(made.get(c, F.lit(c)).alias(c) for c in columns))
    folder = tables.new_folder(rows.sparkSession)
    for s in ("S1", "S2", "S3", "S5"):
        files.write_csv(pairs.where(F.col("strategy") == s).drop("strategy"), f"{folder}/{s}")
    read = files.read_strategies(rows.sparkSession, {s: f"{folder}/{s}" for s in V.STRATEGIES})
    return read.select("strategy", "a_yes_token", "a_question", "b_ticker", F.coalesce("a_entity", F.lit("")).alias("a_entity"), "score")


@query("files_of_manifest", f"""WITH {I.DATED} SELECT CAST(idx AS VARCHAR) AS a_yes_token, category, score, coalesce(strftime(resolution_date, '%Y-%m-%dT%H:%M:%S.000Z'), '') AS resolution_date, coalesce(days_to_resolution, -1) AS days_to_resolution, date_capped FROM resolved""")
def files_of_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest written as CSV files and read again."""
    from gridloom.sources import files, tables

    rows = merge.with_dates(I.dated(spark, d), F.lit(I.AS_OF).cast("timestamp")).withColumn("a_yes_token", F.col("idx").cast("string"))
    rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(c).alias(c) for c in merge.MANIFEST))
    path = f"{tables.new_folder(rows.sparkSession)}/manifest"
    files.write_csv(merge.manifest(rows), path)
    read = files.read_manifest(rows.sparkSession, path)
    return read.select("a_yes_token", "category", "score", F.coalesce(iso_millis(F.col("resolution_date")), F.lit("")).alias("resolution_date"), F.coalesce("days_to_resolution", F.lit(-1.0)).alias("days_to_resolution"), "date_capped")


# ---- verdict log and feed messages ----


@query("verdict_log", f"""WITH {I.SCORED} SELECT 'q' || CAST(idx AS VARCHAR) AS a_question, b_ticker AS b_title, coalesce(a_entity, '') AS a_entity, 'e' AS b_entity, CASE WHEN idx % 3 = 0 THEN 'x' ELSE '' END AS a_identified,
  CASE WHEN idx % 3 <> 0 THEN '' WHEN idx % 9 = 0 THEN 'unknown' ELSE 'x' END AS b_identified, score, CASE WHEN idx % 3 = 0 AND idx % 9 <> 0 THEN 'MATCH' ELSE 'REJECT' END AS verdict, CASE WHEN idx % 3 = 0 THEN 'same' ELSE '' END AS reason FROM scored WHERE score < 0.75""")
def verdict_log(spark: SparkSession, d: str) -> DataFrame:
    return _verdict_log(spark, d)


@query("verification_requests", f"""WITH {I.SCORED} SELECT CAST(idx AS VARCHAR) AS pair_key, substring(repeat('q' || CAST(idx AS VARCHAR) || ' "é" ', 40), 1, 200) AS a_question, b_ticker AS b_title, '' AS b_event_title, coalesce(a_entity, '') AS a_entity FROM scored WHERE score < 0.75""")
def verification_requests(spark: SparkSession, d: str) -> DataFrame:
    """What the verifier is asked of each pair below the threshold, read back from the JSON."""
    k = F.col("idx").cast("string")
    rows = I.scored(spark, d).where(F.col("score") < T.auto_accept).withColumns({"pair_key": k, "a_question": F.repeat(F.concat(F.lit("q"), k, F.lit(' "é" ')), 40), "b_title": F.col("b_ticker"), "a_event_title": F.lit("t"), "b_event_title": F.lit(None).cast("string"), "b_entity": F.lit("e")})
    asked = merge.verification_request(rows).withColumn("x", F.from_json("request", "a_question string, b_title string, b_event_title string, a_entity string"))
    return asked.select("pair_key", "x.*")


@query("report_sample", f"WITH {I.SCORED} SELECT idx, b_ticker, score FROM scored ORDER BY md5(CAST(idx AS VARCHAR)), idx LIMIT 20")
def report_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty pairs for a report, the same in every run."""
    return merge.sample(I.scored(spark, d).select("idx", "b_ticker", "score"), "idx", 20)


@query("verdict_counts", f"""WITH {I.SCORED} SELECT count(*) FILTER (idx % 3 = 0 AND idx % 9 <> 0) AS n_match, count(*) FILTER (idx % 3 <> 0 OR idx % 9 = 0) AS n_reject, 0::BIGINT AS n_error FROM scored WHERE score < 0.75""")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge.verdict_counts(_verdict_log(spark, d))


def _verdict_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("idx")
    rows = I.scored(spark, d).withColumns({"pair_key": k.cast("string"), "a_question": F.concat(F.lit("q"), k.cast("string")), "b_title": F.col("b_ticker"), "a_entity": F.coalesce("a_entity", F.lit("")), "b_entity": F.lit("e")})
    says = F.struct(F.lit("MATCH").alias("verdict"), F.lit("same").alias("reason"), F.lit("x").alias("a_identified"), F.when(k % 9 == 0, "unknown").otherwise("x").alias("b_identified"))
    return merge.verdict_log(rows, rows.where("idx % 3 = 0").select("pair_key", F.to_json(says).alias("reply")))


@query("feed_levels", """WITH e AS (SELECT event_id AS k, user_id % 9 AS m FROM events), frames AS (SELECT k, m, k % 5 AS kind FROM e),
 rows AS (
  SELECT k, 0 AS item, 0 AS pos, 'snapshot' AS kind, 'A' || m AS book, 'bid' AS side, NULL::BIGINT AS tick, NULL::BIGINT AS qty FROM frames WHERE kind = 0
  UNION ALL SELECT k, 0, 1, 'snapshot', 'A' || m, 'bid', 4000, 100 * (k % 7) FROM frames WHERE kind = 0 AND k % 2 = 0
  UNION ALL SELECT k, 0, 2, 'snapshot', 'A' || m, 'bid', 4000, 100 * (k % 3) FROM frames WHERE kind = 0 AND k % 2 = 0
  UNION ALL SELECT k, 0, 0, 'absolute', 'A' || m, 'bid', 100 * (40 + k % 4), 1000 FROM frames WHERE kind = 1
  UNION ALL SELECT k, 0, 1, 'absolute', 'A' || m, 'bid', 100 * (40 + k % 4), 0 FROM frames WHERE kind = 1 AND k % 3 = 0
  UNION ALL SELECT k, 1, 0, 'absolute', 'A' || m, 'ask', 6000, 250 FROM frames WHERE kind = 1
  UNION ALL SELECT k, 0, 0, 'snapshot', 'M' || m || '/yes', 'bid', NULL, NULL FROM frames WHERE kind = 2
  UNION ALL SELECT k, 0, 1, 'snapshot', 'M' || m || '/no', 'bid', NULL, NULL FROM frames WHERE kind = 2
  UNION ALL SELECT k, 0, 2, 'snapshot', 'M' || m || '/no', 'bid', 3000 + k % 5, 500 FROM frames WHERE kind = 2 AND k % 4 > 0)
SELECT k AS seq, item, pos, kind, book, side, coalesce(tick, -1) AS tick, coalesce(qty, -1) AS qty FROM rows""")
def feed_levels(spark: SparkSession, d: str) -> DataFrame:
    """Decoded frames: empty and one-sided books, levels named twice, lists of messages, sides in any case, malformed JSON."""
    return feeds.decode(_frames(spark, d)).select("seq", "item", "pos", "kind", "book", "side", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("tick", "qty")))


@query("feed_subscribed", ORACLE_SQL["feed_levels"])
def feed_subscribed(spark: SparkSession, d: str) -> DataFrame:
    """The same from frames that landed by subscription, three books to a connection, read by the feed source."""
    from gridloom.sources import landing, tables

    frames = _frames(spark, d).withColumn("id", F.concat(F.when(F.col("venue") == "a", "A").otherwise("M"), (F.col("seq") % 7).cast("string")))
    folder = tables.new_folder(frames.sparkSession)
    landing.land(frames, landing.subscriptions(frames, {"a": 3, "b": 3}), folder)
    read = landing.register(frames.sparkSession).read.format("landed_feed").load(folder)
    return feeds.decode(read).select("seq", "item", "pos", "kind", "book", "side", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("tick", "qty")))


@query("feed_books", """WITH e AS (SELECT event_id AS k, 'A' || (user_id % 9) AS book FROM events),
 clears AS (SELECT k, book FROM e WHERE k % 5 = 0), sets AS (
  SELECT k, 0 AS item, 2 AS pos, book, 'bid' AS side, 4000 AS tick, 100 * CASE WHEN k % 3 > 0 THEN k % 3 ELSE k % 7 END AS qty FROM e WHERE k % 5 = 0 AND k % 2 = 0
  UNION ALL SELECT k, 0, 1, book, 'bid', 100 * (40 + k % 4), CASE WHEN k % 3 = 0 THEN 0 ELSE 1000 END FROM e WHERE k % 5 = 1
  UNION ALL SELECT k, 1, 0, book, 'ask', 6000, 250 FROM e WHERE k % 5 = 1),
 live AS (SELECT s.* FROM sets s LEFT JOIN (SELECT book, max(k) AS since FROM clears GROUP BY 1) c USING (book) WHERE (since IS NULL OR k >= since) AND NOT (k % 5 = 0 AND qty <= 0))
SELECT book, side, CAST(tick AS BIGINT) AS tick, CAST(arg_max(qty, k) AS BIGINT) AS size FROM live GROUP BY 1, 2, 3 HAVING arg_max(qty, k) > 0""")
def feed_books(spark: SparkSession, d: str) -> DataFrame:
    """The books of the first venue that those frames leave."""
    return books.absolute_state(feeds.decode(_frames(spark, d).where("venue = 'a'"))).select("book", "side", "tick", "size")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    e, k = I.read(spark, d, "events"), F.col("event_id")
    m = F.col("user_id") % 9

    def level(price: Column, size: Column, *more: Column) -> Column:
        return F.struct(price.cast("string").alias("price"), size.cast("string").alias("size"), *more)

    none = F.array().cast("array<struct<price:string,size:string>>")
    a_id = F.concat(F.lit("A"), m.cast("string"))
    full = F.struct(F.lit("book").alias("event_type"), a_id.alias("asset_id"), F.when(k % 2 == 0, F.array(level(F.lit("0.40"), k % 7), level(F.lit("0.4"), k % 3))).otherwise(none).alias("bids"))
    price = (40 + k % 4) / 100
    changed = [level(price, n, a_id.alias("asset_id"), F.lit(side).alias("side")) for n, side in ((F.lit("10"), "buy"), (F.lit("0"), "BUY"))]
    change = F.struct(F.lit("price_change").alias("event_type"), F.when(k % 3 == 0, F.array(*changed)).otherwise(F.array(changed[0])).alias("price_changes"))
    ask = F.struct(F.lit("price_change").alias("event_type"), F.array(level(F.lit("0.6"), F.lit("2.5"), a_id.alias("asset_id"), F.lit("SELL").alias("side"))).alias("changes"))
    no = F.when(k % 4 > 0, F.array(F.array(((3000 + k % 5) / 10000).cast("string"), F.lit("5")))).otherwise(F.array().cast("array<array<string>>"))
    snapshot = F.struct(F.lit("orderbook_snapshot").alias("type"), F.struct(F.concat(F.lit("M"), m.cast("string")).alias("market_ticker"), no.alias("no_dollars_fp")).alias("msg"))
    listed = F.concat(F.lit("["), F.to_json(change), F.lit(","), F.to_json(ask), F.lit("]"))
    body = F.when(k % 5 == 0, F.to_json(full)).when(k % 5 == 1, listed).when(k % 5 == 2, F.to_json(snapshot)).when(k % 5 == 3, "{broken").otherwise('{"event_type": "other"}')
    return e.select(k.alias("seq"), F.col("ts").cast("timestamp").alias("recv_ts"), F.when(k % 5 == 2, "b").otherwise("a").alias("venue"), body.alias("body"))


def _feed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A log of full books and deltas over 8 events of 4 markets each, and its pairs."""
    e = I.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    m, k = F.col("user_id") % 32, F.col("event_id")
    tick = ((30 + (m * 7 + k * 3) % 40) * 100).cast("bigint")
    a_leg = F.when(k % 2 == 0, "y").otherwise("n")
    rows = [
        (k % 4 < 2, "absolute", F.concat(F.lit("A"), m.cast("string"), a_leg), "ask", tick, F.round(F.col("value") * 100).cast("bigint") + 5000),
        (k % 4 == 2, "delta", F.concat(F.lit("M"), m.cast("string"), F.lit("/yes")), "bid", F.lit(10_000) - tick - 500, F.lit(20_000).cast("bigint") - k % 7 * 3000),
        (k % 4 == 3, "delta", F.concat(F.lit("M"), m.cast("string"), F.lit("/no")), "bid", F.lit(10_000) - tick - 700, F.lit(20_000).cast("bigint") - k % 5 * 4000),
    ]
    x = F.coalesce(*(F.when(c, F.struct(F.lit(kind).alias("kind"), book.alias("book"), F.lit(side).alias("side"), t.cast("bigint").alias("tick"), q.cast("bigint").alias("qty"))) for c, kind, book, side, t, q in rows))
    log = e.select(k.alias("seq"), F.col("ts").alias("recv_ts"), x.alias("x")).select("seq", "recv_ts", "x.*")
    i = F.col("id").cast("string")
    pairs = I.in_utc(spark).range(32).select(F.concat(F.lit("E"), F.floor(F.col("id") / 4).cast("string")).alias("event"), F.concat(F.lit("P"), i).alias("pair"), F.concat(F.lit("A"), i, F.lit("y")).alias("a_yes"), F.concat(F.lit("A"), i, F.lit("n")).alias("a_no"), F.concat(F.lit("M"), i).alias("b_ticker"), (F.col("id") * 20 + 0.5).cast("double").alias("days"), (F.col("id") % 8 == 0).alias("capped"))
    return log, pairs


FEED_LIMITS = V.Thresholds(stale_ms=72 * 3_600_000, cooldown_ms=12 * 3_600_000, oversum=3.2)


def _replay(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.streaming.engine import replay

    return replay(*_feed(spark, d), FEED_LIMITS)


#: The evaluation as sets: sizes at each message by windows, the walks of both legs level by level (in the engine's order of
#: floating-point steps, which fees at a whole cent depend on), then what each evaluation would give without cooldowns; only the
#: cooldowns are folded message by message.
_REPLAY = f"""e AS (SELECT event_id AS k, epoch_us(ts) // 1000 AS ms, user_id % 32 AS m, (30 + ((user_id % 32) * 7 + event_id * 3) % 40) * 100 AS t, value FROM events
), log AS (SELECT k, ms, m, 'A' || m || CASE WHEN k % 2 = 0 THEN 'y' ELSE 'n' END AS book, t AS tick, CAST(round(value * 100) AS BIGINT) + 5000 AS qty FROM e WHERE k % 4 < 2
  UNION ALL SELECT k, ms, m, 'M' || m || '/yes', 10000 - t - 500, 20000 - k % 7 * 3000 FROM e WHERE k % 4 = 2
  UNION ALL SELECT k, ms, m, 'M' || m || '/no', 10000 - t - 700, 20000 - k % 5 * 4000 FROM e WHERE k % 4 = 3
), sums AS (SELECT *, sum(qty) OVER (PARTITION BY book, tick ORDER BY k) AS s FROM log
), sizes AS (SELECT k, m, book, tick, CASE WHEN starts_with(book, 'A') THEN qty ELSE s - least(0, min(s) OVER (PARTITION BY book, tick ORDER BY k)) END AS size FROM sums
), hist AS (SELECT *, coalesce(lead(k) OVER (PARTITION BY book, tick ORDER BY k), 9223372036854775807) AS till FROM sizes
), tops AS (SELECT l.k, l.m, coalesce(max(h.tick) FILTER (h.size > 0), 0) AS top FROM log l JOIN hist h ON h.book = l.book AND h.k <= l.k AND h.till > l.k WHERE l.k % 4 = 2 GROUP BY 1, 2
), filled AS (SELECT l.*, {", ".join(f"coalesce(last_value(CASE WHEN l.m % 4 = {j} THEN top END IGNORE NULLS) OVER w, 0) AS t{j}" for j in range(4))} FROM log l LEFT JOIN tops USING (k)
  WINDOW w AS (PARTITION BY l.m // 4 ORDER BY l.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), evals AS (SELECT k, ms, m, (t0 > 0)::INT + (t1 > 0)::INT + (t2 > 0)::INT + (t3 > 0)::INT >= {FEED_LIMITS.oversum_markets} AND t0 + t1 + t2 + t3 > {round(FEED_LIMITS.oversum * 10_000)} AS oversum,
  {", ".join(f"last_value(CASE WHEN k % 4 = {r} THEN ms END IGNORE NULLS) OVER w AS {name}" for r, name in ((0, "s_ay"), (1, "s_an"), (2, "s_by"), (3, "s_bn")))} FROM filled WINDOW w AS (PARTITION BY m ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), legs AS (SELECT k, ms, m, 1 AS way, 'A' || m || 'y' AS a, 'M' || m || '/yes' AS b, s_ay AS sa, s_by AS sb FROM evals UNION ALL SELECT k, ms, m, 2, 'A' || m || 'n', 'M' || m || '/no', s_an, s_bn FROM evals
), asks AS (SELECT l.k, l.way, 'a' AS leg, h.tick / 10000.0::DOUBLE AS price, h.size / 100.0::DOUBLE AS size FROM legs l JOIN hist h ON h.book = l.a AND h.k <= l.k AND h.till > l.k WHERE h.size > 0
  UNION ALL SELECT l.k, l.way, 'b', round(1.0::DOUBLE - h.tick / 10000.0::DOUBLE, 4), h.size / 100.0::DOUBLE FROM legs l JOIN hist h ON h.book = l.b AND h.k <= l.k AND h.till > l.k WHERE h.size > 0 AND h.tick > 0 AND h.tick < 10000
), lists AS (SELECT k, way, leg, count(*) AS depth, list({{'p': price, 'q': size, 'c': 0.0::DOUBLE, 's': 0.0::DOUBLE}} ORDER BY price) AS c FROM asks GROUP BY 1, 2, 3
), walks AS (SELECT k, way, leg, depth, x.c / x.s AS vwap FROM (SELECT k, way, leg, depth, list_reduce(c, lambda acc, y: CASE WHEN acc.c >= 50 THEN acc ELSE {{'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE,
  'c': acc.c + least(y.q, (50.0::DOUBLE - acc.c) / y.p) * y.p, 's': acc.s + least(y.q, (50.0::DOUBLE - acc.c) / y.p)}} END, {{'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 's': 0.0::DOUBLE}}) AS x FROM lists)
), costs AS (SELECT l.*, a.depth AS da, b.depth AS db, a.vwap + b.vwap * (1.0::DOUBLE + ({_FEE.format(p="b.vwap", c="(50.0::DOUBLE / b.vwap)")}) / ((50.0::DOUBLE / b.vwap) * b.vwap)) AS cost, l.m * 20 + 0.5::DOUBLE AS days
  FROM legs l LEFT JOIN walks a ON a.k = l.k AND a.way = l.way AND a.leg = 'a' LEFT JOIN walks b ON b.k = l.k AND b.way = l.way AND b.leg = 'b'
), ways AS (SELECT *, CASE WHEN sa IS NULL OR sb IS NULL OR ms - sa > {FEED_LIMITS.stale_ms} OR ms - sb > {FEED_LIMITS.stale_ms} THEN 'stale' WHEN coalesce(da, 0) < 2 OR coalesce(db, 0) < 2 THEN 'thin' WHEN cost >= 1 THEN 'no_edge'
  WHEN 1 - cost > 0.15 THEN 'suspect' WHEN days < 1 OR 1 - cost < 0.04::DOUBLE * (CASE WHEN m % 8 = 0 THEN greatest(days, 1095.0::DOUBLE) ELSE days END / 365.0::DOUBLE) THEN 'time_value' ELSE 'trade' END AS outcome FROM costs
), would AS (SELECT e.*, s_ay IS NULL OR s_by IS NULL AS unseen, x.outcome AS o1, 1 - x.cost AS p1, y.outcome AS o2, 1 - y.cost AS p2 FROM evals e JOIN ways x ON x.k = e.k AND x.way = 1 JOIN ways y ON y.k = e.k AND y.way = 2
), fires AS (SELECT m, list([{{'k': k, 'ms': ms}}] ORDER BY k) AS c FROM would WHERE NOT unseen AND NOT oversum AND (o1 = 'trade' OR o2 = 'trade') GROUP BY 1
), fired AS (SELECT m, unnest(list_reduce(c, lambda acc, x: CASE WHEN x[1].ms - acc[len(acc)].ms < {FEED_LIMITS.cooldown_ms} THEN acc ELSE list_concat(acc, x) END)) AS f FROM fires
), told AS (SELECT w.*, w.ms - f.ms < {FEED_LIMITS.cooldown_ms} AS cooling FROM would w ASOF LEFT JOIN (SELECT m, f.k AS k, f.ms AS ms FROM fired) f ON w.m = f.m AND w.k > f.k
), outcomes AS (SELECT k, m, 1 AS way, CASE WHEN cooling THEN 'cooling' WHEN unseen THEN 'unseen' WHEN oversum THEN 'oversum' ELSE o1 END AS outcome, p1 AS profit FROM told
  UNION ALL SELECT k, m, 2, o2, p2 FROM told WHERE NOT coalesce(cooling, false) AND NOT unseen AND NOT oversum AND o1 <> 'trade')"""


@query("replay_outcomes", f"""WITH {_REPLAY} SELECT 'P' || CAST(m AS VARCHAR) AS pair, outcome, count(*) AS n, round(coalesce(avg(profit) FILTER (outcome = 'trade'), 0), 6) AS mean_profit FROM outcomes GROUP BY 1, 2""")
def replay_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the whole log by pair; tests hold them against the stream and a plain loop as well."""
    return _replay(spark, d).groupBy("pair", "outcome").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("profit"), F.lit(0.0)), 6).alias("mean_profit"))


@query("replay_by_sets", ORACLE_SQL["replay_outcomes"])
def replay_by_sets(spark: SparkSession, d: str) -> DataFrame:
    """The same, evaluated with no event in one task."""
    from gridloom.streaming import by_sets

    out = by_sets.replay(*_feed(spark, d), FEED_LIMITS)
    return out.groupBy("pair", "outcome").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("profit"), F.lit(0.0)), 6).alias("mean_profit"))


@query("replay_status", f"""WITH {_REPLAY} SELECT outcome AS counter, count(*) AS n FROM outcomes GROUP BY 1 UNION ALL SELECT 'evaluations', count(*) FROM outcomes WHERE way = 1 HAVING count(*) > 0""")
def replay_status(spark: SparkSession, d: str) -> DataFrame:
    """The counters of the whole log: evaluations, and how often each outcome came."""
    from gridloom.streaming.engine import counters as status

    return status(_replay(spark, d))


@query("counters", f"WITH {_REPLAY} SELECT 'E' || CAST(m // 4 AS VARCHAR) AS event, outcome, count(*) AS n FROM outcomes GROUP BY 1, 2")
def counters(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the whole log by event."""
    return _replay(spark, d).groupBy("event", "outcome").agg(F.count("*").alias("n"))


@query("replay_trades", f"WITH {_REPLAY} SELECT k AS seq, 'P' || CAST(m AS VARCHAR) AS pair, CASE way WHEN 1 THEN 'a_yes_b_no' ELSE 'a_no_b_yes' END AS direction, round(profit, 6) AS profit FROM outcomes WHERE outcome = 'trade'")
def replay_trades(spark: SparkSession, d: str) -> DataFrame:
    """Each trade of the whole log."""
    return _replay(spark, d).where("outcome = 'trade'").select("seq", "pair", "direction", F.round("profit", 6).alias("profit"))
