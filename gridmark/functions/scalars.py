"""Scalar expressions on codes, texts and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Names of provider codes.
SET_PIECES = {"C": "corner", "D": "drop_ball", "F": "free_kick", "G": "goal_kick", "K": "kickoff", "P": "penalty", "T": "throw_in", "O": "open_play"}
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.67, "LOW": 0.33}
OUTCOME_WORDS = (("GOAL", "goal"), ("BLOCKED", "blocked"), ("SAVED", "saved"), ("WOODWORK", "woodwork"), ("OFF TARGET", "off_target"), ("OUT", "off_target"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = clipped(p, eps)
    return F.ln(c / (1 - c))


def named(code: Column, names: dict) -> Column:
    """A code's name; null for a code that has none."""
    return F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[code]


def shot_outcome(text: Column) -> Column:
    """The first outcome whose word a shot's description contains in capitals; ``unknown`` for any other and for none."""
    case = F.lit("unknown")
    for word, outcome in reversed(OUTCOME_WORDS):
        case = F.when(F.contains(text, F.lit(word)), F.lit(outcome)).otherwise(case)
    return case


def player_ref(side: Column, text: Column) -> Column:
    """``away_26`` from a side in any case and the first number of a text; null without a side or a number."""
    number = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(number != "", F.concat(F.lower(side), F.lit("_"), number))


def team_code(team: Column) -> Column:
    """1 home, -1 away, 0 unknown."""
    return F.when(team == "home", 1).when(team == "away", -1).otherwise(0)


def bucket(value: Column, bounds: list[float], labels: list[str], unknown: str | None = None) -> Column:
    """The label of the first upper bound above a value (an exact bound belongs to the next); the last label beyond."""
    case = F.lit(labels[-1])
    for bound, label in reversed(list(zip(bounds, labels, strict=False))):
        case = F.when(value < bound, F.lit(label)).otherwise(case)
    return F.when(value.isNull(), F.lit(unknown)).otherwise(case)


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def normal(*keys: Column) -> Column:
    """A standard normal number that depends on the keys alone."""
    u = F.greatest(uniform(*keys, F.lit("u")), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * uniform(*keys, F.lit("v")))


def home_price(side: Column, usdc: Column, shares: Column) -> Column:
    """The price that a trade puts on the home side."""
    p = F.try_divide(usdc, shares)
    return F.when(side == "home", p).otherwise(1 - p)


def trade_text(wallet: Column, side: Column, usdc: Column, price: Column) -> Column:
    """One line for a trade: short wallet, side, dollars, cents from 1 to 99."""
    cents = F.least(F.greatest(F.round(price * 100), F.lit(1)), F.lit(99)).cast("int")
    return F.format_string("%s..%s %s $%.0f @ %dc", F.left(wallet, F.lit(6)), F.right(wallet, F.lit(4)), F.lower(side), usdc, cents)


def register_sql(spark: SparkSession) -> None:
    """The expressions that users write in SQL, as temporary SQL functions: no Python runs in them."""
    for name, args, body in (
        ("goal_distance", "x DOUBLE, y DOUBLE", "hypot(52.5 - x, y)"),
        ("goal_angle", "x DOUBLE, y DOUBLE", "atan2(abs((52.5 - x) * (-3.66 - y) - (52.5 - x) * (3.66 - y)), (52.5 - x) * (52.5 - x) + (3.66 - y) * (-3.66 - y))"),
        ("sigmoid", "z DOUBLE", "1 / (1 + exp(-z))"),
        ("in_box", "x DOUBLE, y DOUBLE", "x BETWEEN 36 AND 52.5 AND abs(y) <= 20.16"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
