"""Localized numbers, money, counts and ratings as Column expressions.

A text that could be read in two ways that differ by a power of ten gives null, never a guess.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlake.functions.markets import Market

SPACES = "[\\s\\u00a0\\u2007\\u2009\\u202f\\u2060]+"
BIDI = "[\\u200e\\u200f\\u202a-\\u202e]"
NUMBER = "decimal(30,6)"


def strip_currency(text: Column, market: Market) -> Column:
    """Without direction marks, the market's symbols (longest first) and any white space."""
    out = F.regexp_replace(text, BIDI, "")
    for symbol in sorted(market.symbols, key=len, reverse=True):
        out = F.replace(out, F.lit(symbol), F.lit(""))
    return F.regexp_replace(out, SPACES, "")


def _shape(market: Market) -> str:
    """Regex of a whole number of the market: grouped by threes, or ungrouped with no three-digit tail."""
    d, t = re.escape(market.decimal), re.escape(market.thousands)
    plain = f"[0-9]+(?:{d}(?:[0-9]{{0,2}}|[0-9]{{4,}}))?"
    if market.thousands == " ":  # spaces are gone before
        return f"^[-+\\u2212]?{plain}$"
    return f"^[-+\\u2212]?(?:[0-9]{{1,3}}(?:{t}[0-9]{{3}})+(?:{d}[0-9]*)?|{plain})$"


def localized_number(text: Column, market: Market) -> Column:
    """decimal(30,6), null for other shapes: the other locale's separators, wrong groups, an ambiguous tail."""
    s = strip_currency(text, market)
    digits = F.translate(F.replace(s, F.lit(market.thousands), F.lit("")), market.decimal + "\u2212", ".-")
    return F.when(s.rlike(_shape(market)), digits.try_cast(NUMBER))


def half_up(value: Column, places: int = 0) -> Column:
    """Rounded to places, halves towards plus infinity, after a nudge away from zero of one part in 2**52; double."""
    scale = float(10**places)
    nudged = value.cast("double") * F.lit(1.0 + 2.0**-52)
    return F.floor(nudged * scale + 0.5).cast("double") / scale


def money(text: Column, market: Market) -> Column:
    """struct(minor, currency, raw) of a whole price text, else null."""
    minor = F.floor(localized_number(text, market) * 100 + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    return F.when(minor.isNotNull(), F.struct(minor.alias("minor"), F.lit(market.currency).alias("currency"), F.trim(text).alias("raw")))


def whole_money(minor: Column, currency: Column) -> Column:
    """struct(minor, currency) of a count of minor units; null for what is no whole number."""
    return F.when(minor == F.floor(minor), F.struct(minor.cast("long").alias("minor"), currency.alias("currency")))


def money_difference(a: Column, b: Column) -> Column:
    """Minor units of a - b of two money structs; null where the currencies differ."""
    return F.when(a["currency"] == b["currency"], a["minor"] - b["minor"])


def _money_shape(market: Market) -> str:
    """Regex of the number of a price within a text."""
    d, t = re.escape(market.decimal), re.escape(market.thousands)
    return f"[0-9]{{1,3}}(?:{t}[0-9]{{3}})+(?:{d}[0-9]*)?|[0-9]+(?:{d}(?:[0-9]{{4,}}|[0-9]{{0,2}}))?"


def _money_token(text: Column, market: Market) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, BIDI, ""), "[\\u00a0\\u2007\\u2009\\u202f]", " ")
    for symbol in sorted(market.symbols, key=len, reverse=True):
        plain = F.replace(plain, F.lit(symbol), F.lit("|"))
    # the first token that has the market's shape from its first digit to the last digit or separator that touches it
    edge = "0-9.,"
    return F.regexp_extract(plain, f"(?<![{edge}])({_money_shape(market)})(?![{edge}])", 1)


def _token_minor(token: Column, market: Market) -> Column:
    digits = F.translate(F.replace(token, F.lit(market.thousands), F.lit("")), market.decimal, ".").try_cast(NUMBER)
    return F.floor(digits * 100 + F.lit(0.5).cast("decimal(2,1)")).cast("long")


def first_money(text: Column, market: Market) -> Column:
    """minor units of the first readable price in a longer text; a token with digits or separators left over is refused."""
    return _token_minor(_money_token(text, market), market)


def price(text: Column, market: Market) -> Column:
    """As first_money, for texts that are nothing but a price as a rule: a number, with or without a symbol before it, is read by one expression."""
    symbols = "|".join(re.escape(s) for s in sorted(market.symbols, key=len, reverse=True))
    alone = F.get(F.regexp_extract_all(text, F.lit(f"\\A(?:{symbols})?({_money_shape(market)})\\z"), F.lit(1)), 0)
    return _token_minor(F.coalesce(alone, _money_token(text, market)), market)


def count(text: Column, market: Market) -> Column:
    """Integer counts: with a magnitude word, a localized integer, else all digits if there is no decimal separator."""
    words = "|".join(re.escape(w) for w, _ in market.magnitudes)
    pattern = f"(?i)([0-9][0-9.,\\u00a0\\u202f ]*)\\s*({words})(?:\\.|\\b)"
    head, word = F.trim(F.regexp_extract(text, pattern, 1)), F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.lit(None).cast("long")
    for w, f in reversed(market.magnitudes):
        factor = F.when(word == w.lower(), F.lit(f).cast("long")).otherwise(factor)
    # one number is read: the part before a magnitude word, else all digits and separators
    kept = F.regexp_replace(text, "[^0-9.,\\u00a0 ]", "")
    value = localized_number(F.when(word != "", head).otherwise(kept), market) * F.when(word != "", factor).otherwise(1)
    plain = F.when((word == "") & ~kept.rlike(re.escape(market.decimal)), F.regexp_replace(text, "[^0-9]", "").try_cast("long"))
    exact = F.transform(F.array(value), lambda v: F.when((v >= 0) & (v == F.floor(v)), v.cast("long")))
    return F.coalesce(F.get(exact, 0), plain)


def rating(text: Column, market: Market) -> Column:
    """First digit with at most one decimal, 0 to 5."""
    value = F.replace(F.regexp_extract(text, f"([0-9](?:{re.escape(market.decimal)}[0-9])?)", 1), F.lit(market.decimal), F.lit(".")).try_cast("double")
    return F.when(value.between(0, 5), value)


def demand(text: Column, market: Market) -> Column:
    """Lower bound of a phrase like 2K+: the number times its magnitude word; unknown words count once."""
    pattern = "([0-9][0-9.,\\u00a0\\u202f ]*)\\s*([A-Za-z]{1,4})?"
    word = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.lit(1).cast("long")
    for w, f in reversed(market.magnitudes):
        factor = F.when(word == w.lower(), F.lit(f).cast("long")).otherwise(factor)
    base = localized_number(F.trim(F.regexp_extract(text, pattern, 1)), market)
    return F.floor(base * factor).cast("long")


def percent(text: Column) -> Column:
    """First percentage in a text, 0 to 100."""
    value = F.replace(F.regexp_extract(text, "([0-9]{1,3}(?:[.,][0-9]*)?)\\s*%", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value.between(0, 100), value)


def discount_percent(current: Column, listed: Column) -> Column:
    """Percent off in two places; null unless the list price is positive and above the current one."""
    return F.when((listed > 0) & (listed > current), half_up((listed - current) * 100.0 / listed, 2))


def percent_change(before: Column, after: Column) -> Column:
    """Relative change in percent, two places; null without a base."""
    return F.when(before != 0, half_up((after - before) * 100.0 / before, 2))


def landed_price(item: Column, shipping: Column, free: Column) -> Column:
    """Item plus shipping in minor units; unknown shipping that isn't free gives null."""
    return F.when(free, item).otherwise(item + shipping)


def rate(part: Column, whole: Column) -> Column:
    """part / whole in four places, 0 for an empty whole."""
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)), 4), F.lit(0.0))


def backoff_ms(attempt: Column) -> Column:
    """250 ms doubling with each attempt, 5 s at most."""
    return F.least(F.lit(5000), F.lit(250) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def stable_index(text: Column, n: int) -> Column:
    """Remainder by n of the text's 31-polynomial hash modulo 2**32."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32)) % n).cast("long")
