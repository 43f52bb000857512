"""Text clean-up and classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlake.functions.markets import Market
from merchlake.functions.numbers import SPACES, first_money


def clean_text(text: Column) -> Column:
    """White space of any kind runs together as one space; blank gives null."""
    return F.nullif(F.trim(F.regexp_replace(text, SPACES, " ")), F.lit(""))


def first_label(text: Column, labels) -> Column:
    """The first of the labels that the text holds, in any case of letters."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(label.lower())), F.lit(label)) for label in labels], F.lit(None).cast("string"))


def availability_state(text: Column, market: Market) -> Column:
    """State of the first phrase met: states in the market's order, of each the longest phrases first."""
    low, out = F.lower(text), None
    for state, phrases in market.availability:
        for phrase in sorted(phrases, key=len, reverse=True):
            out = F.when(F.contains(low, F.lit(phrase)), state) if out is None else out.when(F.contains(low, F.lit(phrase)), state)
    return out


#: Words that tell an offer's condition, in the order of testing.
CONDITIONS = (
    ("REFURBISHED", ("refurbished", "renewed", "reconditionné", "ricondizionato", "reacondicionado")),
    ("COLLECTIBLE", ("collectible", "collection", "collezione", "coleccionable")),
    ("USED", ("used", "occasion", "usato", "segunda mano")),
    ("NEW", ("new", "neuf", "nuovo", "nuevo", "neu")),
)


def condition(text: Column) -> Column:
    """Offer condition by the first word met; UNKNOWN without any."""
    low, out = F.lower(text), F.lit("UNKNOWN")
    for name, words in reversed(CONDITIONS):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def _ours(name: Column, own_names) -> Column:
    return F.coalesce(first_label(name, own_names).isNotNull(), F.lit(False))


def offer_fulfillment(shipper: Column, seller: Column, own_names) -> Column:
    """Who fulfils an offer: the market itself (AMZ), the market for a seller (FBA), else the seller (FBM), if one is named."""
    return F.when(_ours(seller, own_names), "AMZ").when(_ours(shipper, own_names), "FBA").when(seller.isNull(), "UNKNOWN").otherwise("FBM")


def fulfillment(shipper: Column, seller: Column, own_names) -> Column:
    """Who fulfils a buy box: as for an offer, but a named shipper that is not the market makes it FBM without a seller too."""
    return (
        F.when(shipper.isNull() & seller.isNull(), "UNKNOWN")
        .when(_ours(seller, own_names), "AMZ")
        .when(_ours(shipper, own_names), "FBA")
        .otherwise("FBM")
    )


def delivery_date(text: Column) -> Column:
    """The dated part of a delivery text, kept as text: weekday, day and month in either order."""
    days = "(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag"
    found = F.regexp_extract(text, f"((?:{days}),?\\s+(?:\\p{{L}}+\\s+[0-9]{{1,2}}(?:st|nd|rd|th)?|[0-9]{{1,2}}\\.?(?:st|nd|rd|th)?(?:\\s+\\p{{L}}+)?))", 1)
    return F.nullif(F.trim(found), F.lit(""))


def rank_lines(text: Column, join: str = "in") -> Column:
    """array of struct(rank, category): a line ends at a parenthesis, a newline or the next rank."""
    pattern = f"(?:#|Nr\\.)\\s*([0-9][0-9.,]*)\\s+{join}\\s+([^\\n(#]+?)(?=\\s*(?:\\(|\\n|#|Nr\\.|$))"
    ranks = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(ranks.alias("r"), names.alias("c")), lambda x: F.struct(F.regexp_replace(x["r"], "[.,]", "").try_cast("long").alias("rank"), F.trim(x["c"]).alias("category")))


def humanize_dimension(key: Column) -> Column:
    """color_name becomes Color: a trailing _name goes, underscores part words, words begin with capitals."""
    return F.initcap(F.replace(F.regexp_replace(key, "_name$", ""), F.lit("_"), F.lit(" ")))


def max_resolution(url: Column) -> Column:
    """An image address without the token that asks for a smaller size."""
    return F.regexp_replace(url, "\\._[^/]*_\\.([A-Za-z0-9]+)$", ".$1")


def strip_label(text: Column, labels) -> Column:
    """Without a leading label and the colon after it (also full width)."""
    alternatives = "|".join(f"\\Q{label}\\E" for label in sorted(labels, key=len, reverse=True))
    return F.nullif(F.trim(F.regexp_replace(text, f"^(?i)\\s*(?:{alternatives})\\s*[:\\uff1a]?\\s*", "")), F.lit(""))


def coupon(text: Column, market: Market) -> Column:
    """struct(text, type, percent, minor): PERCENT with its number, AMOUNT with a readable price, UNKNOWN for the rest; null text null."""
    share = F.regexp_extract(text, "([0-9]{1,3})\\s*%", 1).try_cast("int")
    minor = F.when(share.isNull(), first_money(text, market))
    kind = F.when(share.isNotNull(), "PERCENT").when(minor.isNotNull(), "AMOUNT").otherwise("UNKNOWN")
    return F.when(text.isNotNull(), F.struct(text.alias("text"), kind.alias("type"), share.alias("percent"), minor.alias("minor")))


def after_label(text: Column, labels) -> Column:
    """What follows the first of the labels that the text holds; the text itself where nothing does."""
    label = first_label(text, labels)
    rest = F.substring(text, F.position(F.lower(label), F.lower(text)) + F.length(label), F.length(text))
    return F.coalesce(F.when(label.isNotNull(), clean_text(F.regexp_replace(rest, "^[:\\uff1a\\s]+", ""))), text)


#: What a byline puts around a brand's name.
BYLINE_BEFORE, BYLINE_AFTER = ("visit the ", "brand:", "marke:", "besuche den ", "shop "), (" store", " shop", "-store")


def brand_name(byline: Column) -> Column:
    """The name in a byline such as "Visit the Acme Store" or "Brand: Acme"."""
    before = "|".join(f"\\Q{w.strip()}\\E{'\\s+' if w.endswith(' ') else '\\s*'}" for w in BYLINE_BEFORE)
    after = "|".join(f"{'\\s+' if w.startswith(' ') else ''}\\Q{w.strip()}\\E" for w in BYLINE_AFTER)
    return clean_text(F.regexp_replace(F.regexp_replace(clean_text(byline), f"^(?i)(?:{before})", ""), f"(?i)(?:{after})$", ""))


def lookup_label(table: Column, labels) -> Column:
    """Value of the first label (then the first key) of a map whose key holds it, in any case."""
    def value(label):
        return F.get(F.filter(F.map_entries(table), lambda e: F.contains(F.lower(e["key"]), F.lit(label.lower()))), 0)["value"]

    found = [value(label) for label in labels]
    return F.coalesce(*found)


#: What captured pages hold of sessions and persons, as (pattern, replacement) in order, broad ones last.
REDACTIONS = (
    (r"(?i)<script[^>]*>[\s\S]*?ue_id[\s\S]*?</script>", "<script>/* ue telemetry removed */</script>"),
    (r'(?i)("(?:anti-csrftoken-a2z|csrfToken|CSRF_TOKEN|rid|requestId|marketplaceID|sessionId|ubid|session-token)"\s*:\s*)"[^"]*"', '$1"REDACTED"'),
    (r'(?i)(name="(?:anti-csrftoken-a2z|session-id|ubid-main|csrfToken)"[^>]*value=")[^"]*(")', "$1REDACTED$2"),
    (r'(?i)(data-csa-c-(?:item-id|content-id|slot-id)=")[^"]*(")', "$1REDACTED$2"),
    (r"\b\d{3}-\d{7}-\d{7}\b", "REDACTED-SESSION-ID"),
    (r"(?i)(glow-ingress-line2[^>]*>)[^<]*(<)", "$1REDACTED LOCATION$2"),
    (r"""(?i)([?&](?:pd_rd_[a-z]+|pf_rd_[a-z]+|qid|sr|linkCode|tag|ascsubtag)=)[^&"'\s]*""", "$1REDACTED"),
)


def sanitize_html(html: Column, patterns=REDACTIONS) -> Column:
    """Captured pages without private values: (regex, replacement) in order."""
    for pattern, replacement in patterns:
        html = F.regexp_replace(html, pattern, replacement)
    return html


#: Where pages carry the token of a form, keys of an answer that tell whether a place was taken.
TOKENS = (r"""(?i)csrfToken\s*=\s*["']([^"']+)["']""", r"""CSRF_TOKEN\s*:\s*["']([^"']+)["']""", r"""name=["']anti-csrftoken-a2z["'][^>]*value=["']([^"']+)["']""", r'''"anti-csrftoken-a2z"\s*:\s*"([^"]+)"''')
ANSWERS = ("sembuUpdated", "success", "isValidAddress")


def csrf_token(html: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in TOKENS])


def location_accepted(status: Column, body: Column) -> Column:
    """Whether an answer takes the place: 2xx or 3xx, and the first of ANSWERS that it holds is not false."""
    told = F.coalesce(*[F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False) for v in (F.get_json_object(body, f"$.{k}") for k in ANSWERS)])
    return (status >= 200) & (status < 400) & F.coalesce(told, F.lit(True))


def location_payload(postal: Column, country: Column) -> Column:
    """The form of a place, as a map."""
    fixed = {"locationType": "LOCATION_INPUT", "storeContext": "generic", "deviceType": "web", "pageType": "Detail", "actionSource": "glow"}
    base = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv], F.lit("zipCode"), postal)
    code = F.nullif(F.upper(F.trim(country)), F.lit(""))
    return F.when(code.isNotNull(), F.map_concat(base, F.create_map(F.lit("countryCode"), code))).otherwise(base)


def location_verified(indicator: Column, postal: Column) -> Column:
    """Whether a page's place text holds the postal code, or its first five digits if it has four at least; null without a text."""
    digits = F.substring(F.regexp_replace(postal, "[^0-9]", ""), 1, 5)
    plain = F.lower(F.regexp_replace(indicator, "\\s+", ""))
    code = F.lower(F.regexp_replace(postal, "\\s+", ""))
    return F.when(indicator.isNotNull(), F.contains(plain, code) | ((F.length(digits) >= 4) & F.contains(plain, digits)))
