"""Word lists, patterns, rule tables and thresholds that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Stop words of all strategies.
COMMON_STOP = "a an and at be by for in is of on or that the this to what who will 2024 2025 2026 2027 2028 2029 2030".split()
# Further stop words by strategy.
EXTRA_STOP = {
    "S1": "act after become before bill confirmed democrat democratic during election finish first governor house law mayoral new next nominated nominee parliamentary party presidential primary race republican seat seats second senate third vote win winner won year".split(),
    "S2": "beat defeat game match vs win winner won".split(),
    "S3": "after award become before champion championship conference division during eastern finish first new next season second third title trophy western win winner won year".split(),
    "S4": "bank central cut decision decrease hike hold increase meeting rate reserve".split(),
    "S5": "after before how many next year".split(),
}
# Words that compare.
DIRECTIONAL = "less more greater above below between least exceed under over than".split()
LESS = ["less than", "below", "under", "fewer than"]
MORE = ["above", "more than", "greater than", "over", "at least", "exceed"]
# Phrases of inclusion and exclusion.
INCLUSION = [
    "played in", "held in", "hosted in", "hosted by", "takes place in", "remain", "remains", "stay", "stays", "stays with",
    "kept", "keeps", "added", "adds", "join", "joins", "joining", "added to", "approved", "confirmed", "enacted", "passed",
    "becomes", "elected", "nominated", "appointed", "launched", "released", "opens", "legalized", "allowed",
]
EXCLUSION = [
    "relocated", "relocated away", "moved from", "moved out", "removed", "removed from", "canceled", "cancelled", "exits",
    "exit", "leaves", "leaving", "departs", "departure", "rejected", "blocked", "vetoed", "struck down", "out as", "ousted",
    "fired", "resigns", "resignation", "banned", "outlawed", "prohibited", "withdraws", "withdrawn",
]
# Placeholder names.
PLACEHOLDER_NOUNS = ["person", "candidate", "player", "artist", "team", "placeholder"]
PLACEHOLDERS = {"S1": ["another candidate", "another player", "other"], "S3": ["another candidate", "other"]}
# Patterns of titles by sport, the first rule that matches wins.
TITLE_SPORTS = [
    ("NBA", [r"\bnba\b", "basketball", r"\bnba\s"]),
    ("NHL", [r"\bnhl\b", "hockey", "stanley cup"]),
    ("NFL", [r"\bnfl\b", "pro football"]),
    ("MLB", [r"\bmlb\b", "baseball", r"\bal\s+east\b", r"\bnl\s+east\b", r"\bal\s+west\b", r"\bnl\s+west\b", r"\bal\s+central\b", r"\bnl\s+central\b", "cy young", "hank aaron"]),
    ("MLS", [r"\bmls\b"]),
    ("F1", [r"\bf1\b", "formula", "grand prix"]),
    ("FIFA", [r"\bfifa\b", "world cup"]),
    ("EPL", ["premier league", r"\bepl\b"]),
    ("La_Liga", ["la liga"]),
    ("Serie_A", ["serie a"]),
    ("Bundesliga", ["bundesliga"]),
    ("Ligue_1", ["ligue 1"]),
    ("UEFA_CL", ["champions league"]),
    ("UEFA_EL", ["europa league"]),
    ("UEFA_ECL", ["conference league"]),
    ("Tennis", ["french open", "miami open"]),
    ("UFC", [r"\bufc\b"]),
    ("IPL", [r"\bipl\b"]),
    ("PGA", [r"\bpga\b", "houston open"]),
    ("NCAAM", [r"\bncaa\b", "college basketball", "naismith"]),
    ("FA_Cup", ["fa cup"]),
    ("Chess", ["fide", "candidates tournament"]),
    ("Ballon_dOr", ["ballon d"]),
    ("Cricket", ["t20", "odi", "cricket"]),
    ("PFA", ["pfa"]),
]
# Ticker prefixes by sport, the longest that matches wins.
TICKER_SPORTS = {
    "KXNBA": "NBA", "KXNHL": "NHL", "KXNFL": "NFL", "KXMLB": "MLB", "KXMLS": "MLS", "KXF1": "F1", "KXWC": "FIFA", "KXEPL": "EPL",
    "KXPREMIER": "EPL", "KXLALIGA": "La_Liga", "KXSERIEA": "Serie_A", "KXBUNDES": "Bundesliga", "KXLIGUE1": "Ligue_1",
    "KXUCL": "UEFA_CL", "KXUEL": "UEFA_EL", "KXUECL": "UEFA_ECL", "KXFACUP": "FA_Cup", "KXFO": "Tennis", "KXUFC": "UFC",
    "KXIPL": "IPL", "KXPGA": "PGA", "KXHOUSTON": "PGA", "KXCOLLEGE": "NCAAM", "KXBALLON": "Ballon_dOr", "KXFIDE": "Chess",
    "KXPFA": "PFA", "KXT20": "Cricket",
}
# Contract types that are dropped.
LITERAL_DROPS = {"S1": ["More Markets", "Lower Strikes", "Lower strikes", "Toss Match Double"], "S4": ["More Markets", "Lower Strikes"], "S5": ["More Markets", "Lower Strikes"]}
SPREAD_PREFIX = "Spread:"
PATTERN_DROPS = {
    "S2": ["^Spread:", "^Over ", "^Under ", "Total ", "More Markets", "Lower Strikes", "Toss Match", "Handicap", " - More Markets$", "end in a draw", "Draw at halftime"],
    "S3": ["^Spread:", "^Over ", "^Under ", "Total ", "More Markets", "Lower Strikes", "Toss Match", "Handicap"],
}
# What makes a question numeric, and where its bounds are; in order, the first that matches wins.
NUMERIC = [
    r"between\s+[\d.]+%?\s+and\s+[\d.]+%?",
    r"(more|greater|above|over|at least|exceed)\s+[\d.]+",
    r"(less|below|under|fewer)\s+than\s+[\d.]+",
    r"[\d.]+ (or more|or higher|or above|\+)",
    r"[\d.]+%?\s*[-–]\s*[\d.]+%?",
]
NUMERIC_LAST = {"S4": r"(between|be)\s+[\d.,]+m?\s*(and|&)\s*[\d.,]+m?", "S5": r"between\s+[\d.,]+\s*(and|&)\s*[\d.,]+"}
BOUNDS_PERCENT = ("both", r"between\s+([\d.]+)%?\s+and\s+([\d.]+)%?")
BOUNDS_COMMA = ("both", r"between\s+([\d,]+)\s*(?:and|&)\s*([\d,]+)")
BOUNDS_SINGLE = [
    ("upper", r"less than\s+([\d.]+)"),
    ("lower", r"at least\s+([\d.]+)"),
    ("lower", r"(?:above|more than|greater than|over|exceed)\s+([\d.]+)"),
    ("upper", r"(?:below|under)\s+([\d.]+)"),
    ("lower", r"([\d.]+)%?\s+or\s+(?:higher|more|above)"),
]
BOUNDS_DASH = ("both", r"([\d,]+)\s*[-–]\s*([\d,]+)")
BOUNDS = {"S4": [BOUNDS_PERCENT, *BOUNDS_SINGLE], "S5": [BOUNDS_PERCENT, BOUNDS_COMMA, *BOUNDS_SINGLE, BOUNDS_DASH]}
# Categories by strategy; both sport strategies take Sports.
CATEGORIES = {
    "S1": ["Elections", "Politics", "Entertainment", "Mentions"],
    "S2": ["Sports"],
    "S3": ["Sports"],
    "S4": ["Economics", "Climate and Weather"],
    "S5": ["Companies", "Financials", "Science and Technology", "Crypto", "World"],
}
OPEN_STATUS = ["open", "unopened", "active"]
GDP_TICKER, GDP_DROPS = "KXGDPYEAR-26", "China|UK|World"


@dataclass(frozen=True)
class Thresholds:
    """Limits of matching, dates and pricing."""

    match: float = 0.5
    auto_accept: float = 0.75
    date_cap_days: float = 365.0
    fee: float = 0.07
    a_fee: float = 0.0
    risk_free: float = 0.04
    min_days: float = 1.0
    long_days: float = 1095.0
    suspect: float = 0.15
    oversum: float = 1.05
    oversum_markets: int = 3
    stale_ms: int = 5000
    levels: int = 2
    target: float = 50.0
    cooldown_ms: int = 60_000


@dataclass(frozen=True)
class Strategy:
    """How one family of categories is aligned; the differences are data, not code."""

    name: str
    anonymous: bool = False
    digits_exact: bool = False
    direction_exact: bool = False
    digit_divergence: bool = False
    bundle_from: int | None = None  # least size of the shorter entity for the bundle guard
    opposing_direction: bool = False
    timeframe: bool = False
    numeric: bool = False
    end_date: bool = True
    event_dedup: bool = True
    pair_dedup: bool = True
    suffix_parts: int = 1  # least parts of a ticker for the suffix fallback
    category: str | None = None
    split: str | None = None  # "h2h" or "awards": which sport titles it takes
    sport_guard: bool = False
    country_guard: bool = False
    more_markets: bool = True

    @property
    def stop(self) -> list[str]:
        return COMMON_STOP + EXTRA_STOP[self.name]


STRATEGIES = {
    "S1": Strategy("S1", True, True, True, True, 3, True, event_dedup=False, suffix_parts=3, more_markets=False),
    "S2": Strategy("S2", suffix_parts=3, category="Sports_H2H", split="h2h"),
    "S3": Strategy("S3", True, suffix_parts=3, category="Sports_Awards", split="awards", sport_guard=True),
    "S4": Strategy("S4", digits_exact=True, direction_exact=True, bundle_from=0, timeframe=True, numeric=True, end_date=False, country_guard=True),
    "S5": Strategy("S5", digits_exact=True, direction_exact=True, bundle_from=0, timeframe=True, numeric=True, end_date=False, pair_dedup=False),
}
