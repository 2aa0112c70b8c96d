"""Trade tapes and price histories."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.operators import machines, sequential

# Fixed value: the number of bytes of a word in a chain log's data, as hex digits.
WORD = 64


def jumps(trades: DataFrame, keys: list[str], time: str, price: str, back: int, least: float, rows: int) -> DataFrame:
    """Trades at least ``least`` above the median of the ``back`` micros before them, with ``rows`` earlier trades there.

    The median moves with the window (``machines.TrailingMedian``): a trade comes and goes once, whereas an aggregate over a sliding frame reads the frame for each row.
    """
    seen = sequential.along(trades, keys, [time], [time, price], lambda: machines.TrailingMedian(back), "_m double, _n long")
    return seen.where((F.col("_n") >= rows) & (F.col(price) >= F.col("_m") + least)).withColumn("jump", F.col(price) - F.col("_m")).drop("_m", "_n")


def spread(trades: DataFrame, keys: list[str], time: str, order: str, most: int) -> DataFrame:
    """``trades`` with ``at_us``: those of one time spread evenly over the gap to the next time, ``most`` at most."""
    blocks = trades.select(*keys, time).distinct()
    width = blocks.withColumn("_width", F.least(F.coalesce(F.lead(time).over(Window.partitionBy(*keys).orderBy(time)) - F.col(time), F.lit(most)), F.lit(most)))
    block = Window.partitionBy(*keys, time)
    rows = trades.withColumns({"_i": F.row_number().over(block.orderBy(order)) - 1, "_c": F.count("*").over(block)}).join(width, [*keys, time])
    return rows.withColumn("at_us", F.col(time) + F.floor(F.col("_width") * F.col("_i") / F.col("_c"))).drop("_width", "_i", "_c")


def tumbling(trades: DataFrame, time: str, width: str, value: Column, buys: Column) -> DataFrame:
    """Count, range and volume by side of each window; the same plan runs on a stream with a watermark."""
    by = trades.groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high"), F.round(F.sum(F.when(buys, value)), 4).alias("bought"), F.round(F.sum(F.when(~buys, value)), 4).alias("sold"))
    return by.select(F.col("window.start").alias("hour_start"), "n", "low", "high", "bought", "sold")


def moves(points: DataFrame, keys: list[str], time: str, price: str) -> DataFrame:
    """The points at which a price differs from the one before, with that one as ``old``."""
    return points.withColumn("old", F.lag(price).over(Window.partitionBy(*keys).orderBy(time))).where(F.col("old").isNotNull() & (F.col("old") != F.col(price)))


def _word(data: Column, n: int) -> Column:
    return F.substring(data, 3 + WORD * n, WORD)


def _zeros(digits: Column) -> Column:
    return (digits != "") & (F.ltrim(digits, F.lit("0")) == "")


def _fits(word: Column) -> Column:
    """Whether a word's amount is below 2^96: all its other digits are zero."""
    return _zeros(F.left(word, F.lit(WORD - 24)))


def _amount(word: Column) -> Column:
    """A word's amount over a million; null at 2^96 or more (``_fits``).

    Below 2^52 a double has the number itself, so one division rounds once; others are decimals, from their last three groups of eight hex digits.
    """
    groups = [F.conv(F.substring(word, WORD - 8 * (i + 1) + 1, 8), 16, 10).cast("decimal(10,0)") * F.lit(Decimal(16 ** (8 * i))) for i in range(3)]
    small = (F.length(word) == WORD) & _zeros(F.left(word, F.lit(WORD - 13)))
    return F.when(small, F.conv(F.right(word, F.lit(13)), 16, 10).cast("double") / 1e6).when(_fits(word), ((groups[0] + groups[1] + groups[2]) / 1000000).cast("double"))


def matched_trades(logs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Trades from logs (block, log_index, ts, tx, topics, data): side, token, maker and taker amounts as 32-byte words.

    A buy pays the maker amount and gets the taker amount, a sale the reverse; both have six decimals.  ``tokens`` (token, outcome) is joined on
    the hex word, as ids of 256 bits fit no number; logs of other tokens are dropped.  ``overflow``: an amount of 2^96 or more, which is null then.
    """
    d = F.col("data")
    words = logs.select("block", "log_index", "ts", "tx", "topics", *[_word(d, n).alias(f"_w{n}") for n in range(4)])
    maker, taker = F.col("_w2"), F.col("_w3")
    rows = words.select("block", "log_index", "ts", "tx", F.when(F.right("_w0", F.lit(1)) == "0", "BUY").otherwise("SELL").alias("side"), F.lower("_w1").alias("token"), _amount(maker).alias("maker"), _amount(taker).alias("taker"), (~(_fits(maker) & _fits(taker))).alias("overflow"), F.concat(F.lit("0x"), F.right(F.element_at("topics", 3), F.lit(40))).alias("wallet"))
    buy = F.col("side") == "BUY"
    return rows.join(tokens, "token").select("block", "log_index", "ts", "side", "outcome", F.when(buy, F.col("maker")).otherwise(F.col("taker")).alias("usdc"), F.when(buy, F.col("taker")).otherwise(F.col("maker")).alias("shares"), "wallet", "tx", "overflow")


def covered(asked: DataFrame, ingested: DataFrame, key: str) -> DataFrame:
    """Asked intervals (start_s, end_s) with whether the ingested range of their key holds them."""
    have = ingested.groupBy(key).agg(F.min("start_s").alias("_a"), F.max("end_s").alias("_b"))
    return asked.join(have, key, "left").withColumn("covered", F.coalesce((F.col("_a") <= F.col("start_s")) & (F.col("end_s") <= F.col("_b")), F.lit(False))).drop("_a", "_b")
