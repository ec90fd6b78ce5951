"""Derived columns and filters of vendor tables: options, stocks, links, quotes and symbols.

Column names default to those the vendors use; every function takes others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Axis, ratio
from .quantiles import column_quantiles

AX = Axis()

#: Share codes of common stock, units, funds and REITs.
SHARE_CODES = (10, 11, 12, 18, 30, 31)
#: Link types that join no security, and the mark of a link that isn't primary.
DEAD_LINKS, NOT_PRIMARY = ("LD", "LX", "LS"), "N"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def option_enrich(
    df: DataFrame, contract: str = "optionid", symbol: str = "symbol", date: str = "date", expiry: str = "exdate", strike: str = "strike_price", bid: str = "best_bid", offer: str = "best_offer",
    volume: str = "volume", size: str = "contract_size", factor: str = "cfadj", interest: str = "open_interest",
) -> DataFrame:
    """df with unique_optionid, exdays, the strike in currency, mid price, relative spread (null below 0), dollar volume and split-adjusted quotes, price, volume and open interest."""
    mid = (F.col(bid) + F.col(offer)) / 2
    wide = ratio(F.col(offer) - F.col(bid), mid)
    return df.withColumns(
        {
            "unique_optionid": F.concat(F.col(contract).cast("string"), F.col(symbol).cast("string")), "exdays": F.date_diff(expiry, date), strike: F.col(strike) / 1000,
            "opt_offer_adj": F.col(offer) * F.col(factor), "opt_bid_adj": F.col(bid) * F.col(factor), "opt_prc": mid, "opt_spread": F.when(wide >= 0, wide),
            "opt_vol_adj": ratio(F.col(volume) * F.col(size), F.col(factor)), "opt_vold": F.col(volume) * F.col(size) * mid, "opt_prc_adj": mid * F.col(factor),
            "open_interest_adj": ratio(interest, factor),
        }
    )


def stock_enrich(
    df: DataFrame, price: str = "prc", volume: str = "vol", shares: str = "shrout", r: str = "ret", opening: str = "openprc", high: str = "askhi", low: str = "bidlo", factor: str = "cfacshr",
) -> DataFrame:
    """Rows with a price, made positive, with dollar volume, shares in units, size, returns of the opening, high and low price, and split-adjusted volume and price."""
    p = F.abs(price)
    back = lambda c: ratio((1 + F.col(r)) * F.col(c), p) - 1
    return df.filter(F.col(price) != 0).withColumns(
        {
            price: p, "vol_d": p * F.col(volume), shares: F.col(shares) * 1000, "mktcap": p * (F.col(shares) * 1000), "ret_o": back(opening), "ret_h": back(high), "ret_l": back(low),
            "vol_adj": F.col(volume) * F.col(factor), "prc_adj": ratio(p, F.col(factor)),
        }
    )


def security_filter(df: DataFrame, column: str = "shrcd", codes: tuple = SHARE_CODES) -> DataFrame:
    return df.filter(F.col(column).isin(*codes))


def link_filter(df: DataFrame, security: str = "lpermno", primary: str = "linkprim", kind: str = "linktype", not_primary=NOT_PRIMARY, dead: tuple = DEAD_LINKS) -> DataFrame:
    """Links with a security that are primary and alive; a null mark or type goes, as no comparison holds for it."""
    return df.filter(F.col(security).isNotNull() & (F.col(primary) != not_primary) & ~F.col(kind).isin(*dead))


def earnings_surprise(df: DataFrame, actual: str = "actual", mean: str = "meanest", deviation: str = "stdev") -> DataFrame:
    """df with ue, the unexpected earnings, and sue, in standard deviations of the estimates."""
    ue = F.col(actual) - F.col(mean)
    return df.withColumns({"ue": ue, "sue": ratio(ue, F.col(deviation))})


def report_date(df: DataFrame, dates: list[str], key: str, length: int, date: str = "date") -> DataFrame:
    """Rows with a report date, the latest of those not null, and the key cut to its length."""
    return df.withColumns({date: F.greatest(*dates), key: F.substring(key, 1, length)}).filter(F.col(date).isNotNull())


def fundamental_ratios(df: DataFrame, equity: str = "ceqq", size: str = "mktcap") -> DataFrame:
    """df with bm, book to market (equity in millions), and pb, its inverse."""
    bm = ratio(F.col(equity) * 1e6, F.col(size))
    return df.withColumns({"bm": bm, "pb": ratio(F.lit(1.0), bm)})


def illiquidity(r: Column | str, dollar_volume: Column | str) -> Column:
    """Amihud's ratio of absolute return and dollar volume."""
    return ratio(F.abs(_c(r)), _c(dollar_volume))


def turnover(volume: Column | str, shares: Column | str) -> Column:
    return ratio(_c(volume), _c(shares))


def quote_spread(bid: Column | str, ask: Column | str) -> Column:
    return ratio(_c(ask), _c(bid)) - 1


def spread_pct(bid: Column | str, ask: Column | str) -> Column:
    """Spread over the mid quote."""
    return ratio(_c(ask) - _c(bid), (_c(ask) + _c(bid)) / 2)


def quote_values(df: DataFrame, bid: str = "bid", ask: str = "ask", bid_size: str = "bidQuantity", ask_size: str = "askQuantity") -> DataFrame:
    """df with the spread over the mid quote and the value of either side of the book."""
    return df.withColumns({"spread": spread_pct(bid, ask), "bidValue": F.col(bid) * F.col(bid_size), "askValue": F.col(ask) * F.col(ask_size)})


def contract_ratios(df: DataFrame, strike: str = "strike", price: str = "prc", option: str = "opt_prc", delta: str = "delta", realized: Column | str = "ret_std", implied: str = "iv") -> DataFrame:
    """df with moneyness ks, price ratio p_ratio, elasticity and realised less implied volatility rv_iv."""
    return df.withColumns({"ks": ratio(strike, price), "p_ratio": ratio(option, price), "elasticity": ratio(F.col(delta) * F.col(price), F.col(option)), "rv_iv": _c(realized) - F.col(implied)})


def shift_after(contract: str, date: str, value: str, cut: str) -> Column:
    """A contract's value up to the cut-off date; after it that of the contract's next date, as vendors that report a day late need (open interest)."""
    following = F.lead(value).over(Window.partitionBy(contract).orderBy(date))
    return F.when(F.col(date) <= F.lit(cut).cast("timestamp"), F.col(value)).otherwise(following)


def average_absolute(*columns: Column | str) -> Column:
    """Mean of absolute values; null where one is."""
    return reduce(lambda a, b: a + b, [F.abs(_c(c)) for c in columns]) / len(columns)


def weekday_filter(df: DataFrame, column: str, days: tuple[str, ...] = ("Fri", "Sat")) -> DataFrame:
    """Rows whose date falls on one of the days (Mon ... Sun)."""
    return df.filter(F.date_format(column, "E").isin(*days))


def threshold_position(signal: Column | str, cutoff: float) -> Column:
    """1 above the cutoff, -1 below its negative, 0 elsewhere."""
    s = _c(signal)
    return F.when(s > cutoff, 1).when(s < -cutoff, -1).otherwise(0)


def forward_position_return(signal: Column | str, cutoff: float, r: str = "ret", ax: Axis = AX) -> Column:
    """The position times the entity's next return."""
    return threshold_position(signal, cutoff) * F.lead(r).over(ax.history())


#: Parts of the names of leveraged tokens.
LEVERAGED = ("DOWN", "UP", "BULL", "BEAR")


def symbol_filter(df: DataFrame, column: str, pattern: str, leveraged: tuple[str, ...] = LEVERAGED, exclude: tuple[str, ...] = (), repair: dict[str, str] | None = None, base: str = "base") -> DataFrame:
    """Rows whose symbol matches, with the pattern's first group as ``base``; leveraged and excluded names go, cut ones are repaired."""
    found = F.regexp_extract(column, pattern, 1)
    out = df.withColumn(base, found).filter(F.col(base) != "")
    if leveraged:
        out = out.filter(~F.col(column).rlike("|".join(leveraged)))
    if repair:
        out = out.replace(repair, subset=[base])
    return out.filter(~F.col(base).isin(*exclude)) if exclude else out


def classify_by_pattern(column: str, patterns: dict[str, str], default: str | None = None) -> Column:
    """The code of the first pattern (pattern: code) that the text holds."""
    out = F.lit(default)
    for pattern, code in reversed(patterns.items()):
        out = F.when(F.col(column).rlike(pattern), code).otherwise(out)
    return out


def normalize_klines(df: DataFrame, times: tuple[str, ...] = ("open_time", "close_time"), numbers: tuple[str, ...] = ("open", "high", "low", "close", "volume"), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Keys, times as timestamps (from milliseconds) and numbers as doubles (from text; null where they aren't), in this order."""
    return df.select(*keys, *[F.timestamp_millis(F.col(t).cast("long")).alias(t) for t in times], *[F.col(n).try_cast("double").alias(n) for n in numbers])


def step_precision(column: str) -> Column:
    """Decimals of a tick written as text (0.010 has two); 0 for whole steps and null."""
    return F.coalesce(F.length(F.nullif(F.regexp_extract(column, r"^0\.(.*[1-9])", 1), F.lit(""))), F.lit(0))


def size_exchange_filter(df: DataFrame, size: Column, exchange: str, closed: tuple = ("OTC",), listed: Column | None = None) -> DataFrame:
    """Rows in one of the size classes (a condition), not on a closed exchange, and listed."""
    return df.filter(size & ~F.col(exchange).isin(*closed) & (F.lit(True) if listed is None else listed))


def flatten_snapshot(df: DataFrame, fields: dict[str, str], previous: str, updated: str, since: Column, schema: str | None = None, column: str | None = None) -> DataFrame:
    """Rows updated since a time, with nested fields (name: path) as columns and r_<name>, their returns over the previous close.

    A column of JSON text is read by its schema first.
    """
    fresh = df.filter(F.col(updated) >= since)
    if schema:
        fresh = fresh.withColumn(column, F.from_json(column, schema))
    flat = fresh.withColumns({n: F.col(p) for n, p in fields.items()})
    return flat.withColumns({f"r_{n}": ratio(F.col(n).cast("double"), F.col(previous).cast("double")) - 1 for n in fields if n != previous})


def side_spread(df: DataFrame, value: str, flag: str = "cp_flag", ax: Axis = AX) -> DataFrame:
    """Per time and entity with calls and puts: their total and (C + P) / (C - P)."""
    side = lambda f: F.sum(F.when(F.col(flag) == f, F.col(value)))
    both = df.groupBy(ax.time, ax.name).agg(side("C").alias("__c"), side("P").alias("__p")).filter("__c is not null and __p is not null")
    c, p = F.col("__c"), F.col("__p")
    return both.select(ax.time, ax.name, (c + p).alias("total"), ratio(c + p, c - p).alias("spread"))


def liquidity_screen(df: DataFrame, above: dict[str, float], present: tuple[str, ...] = ()) -> DataFrame:
    """Rows with each column above its level and none of ``present`` null."""
    return df.filter(reduce(lambda a, b: a & b, [*(F.col(c) > v for c, v in above.items()), *(F.col(c).isNotNull() for c in present)]))


def benchmark_join(df: DataFrame, benchmark, r: str = "ret", ax: Axis = AX) -> DataFrame:
    """df with the benchmark entity's return at the same time (bench) and the return over it (active)."""
    bench = df.filter(F.col(ax.name) == benchmark).select(ax.time, F.col(r).alias("bench"))
    return df.join(bench, ax.time).withColumn("active", F.col(r) - F.col("bench"))


def factor_join(df: DataFrame, factors: DataFrame, form: str = "yyyyMM", key: str = "key", ax: Axis = AX) -> DataFrame:
    """df with the factors whose key is its date in the given form (yyyyMMdd, yyyyMM, yyyy)."""
    return df.withColumn(key, F.date_format(ax.time, form)).join(factors, key)


def market_breadth(df: DataFrame, r: str = "ret", ax: Axis = AX) -> DataFrame:
    """Per time the share of entities with a return of 0 or more; a null one counts as less."""
    return df.groupBy(ax.time).agg(F.avg(F.when(F.col(r) >= 0, 1.0).otherwise(0.0)).alias("breadth"))


def equal_weight_portfolio(df: DataFrame, r: Column | str, position: Column | str | None = None, ax: Axis = AX) -> DataFrame:
    """Per time the mean of return times position, of the return alone without one."""
    value = _c(r) if position is None else _c(r) * _c(position)
    return df.groupBy(ax.time).agg(F.avg(value).alias("r"))


def distinct_lookup(df: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Distinct keys of df that were selected."""
    return df.join(selected.select(key), key, "left_semi").select(key).distinct()


def count_symbols_by_quote(df: DataFrame, quote: str, base: str) -> DataFrame:
    """Symbols and distinct bases of each quote, most first."""
    return df.groupBy(quote).agg(F.count("*").alias("n"), F.count_distinct(base).alias("bases")).orderBy(F.desc("n"), quote)


def grid_summary(df: DataFrame, keys: list[list[str]], value: str) -> DataFrame:
    """Mean, least and most of the value over each of several lists of parameters, in one pass."""
    columns = list(dict.fromkeys(c for k in keys for c in k))
    sets = [[F.col(c) for c in k] for k in keys]
    return df.groupingSets(sets, *columns).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def quantile_threshold(df: DataFrame, column: str, p: float = 0.5) -> DataFrame:
    """df with position: 1 above the column's quantile over all rows, 0 elsewhere."""
    cut = column_quantiles(df, [column], [p]).select(F.col("q")[0].alias("__q"))
    return df.crossJoin(F.broadcast(cut)).withColumn("position", F.when(F.col(column) > F.col("__q"), 1).otherwise(0)).drop("__q")  # one row


def min_history(df: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Rows of keys that have k rows or more."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("__n") >= k).drop("__n")


def user_item_matrix(ratings: DataFrame, user: str, item: str, value: str, scale: float = 1.0) -> DataFrame:
    """The rating of each user and item, in long form: what a pivoted matrix would fill with zeros isn't stored."""
    return ratings.groupBy(user, item).agg((F.avg(value) / scale).alias("rating"))
