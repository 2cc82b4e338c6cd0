"""Scalar functions on text: cleaning, keys, masks, rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tier-2 types; every other type is tier 1.
TIER_2 = ("email", "phone", "address", "person_name", "date_of_birth")
#: All types.
TYPES = ("password", "otp", "card_number", "cvv", "card_expiry", "aadhaar", "pan", "ssn", "passport", "bank_account", "ifsc", "face", *TIER_2)
#: Fixed value: how what was taken out is marked.
MARKER = r"\[(?:REDACTED:[A-Z_]+|[A-Z_]+_[0-9]+)\]"
#: White space as browsers see it: Java's class lacks no-break space, BOM and the separators.
BLANK = "[\\s\\u00A0\\uFEFF\\p{Z}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column | str) -> Column:
    """Empty text counts as no text."""
    return F.nullif(col(x), F.lit(""))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is worked out once, however often `f` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clip(x: Column | str, most: int) -> Column:
    """White space collapsed and trimmed; longer text is cut at `most` and gets an ellipsis. Empty becomes null."""
    flat = F.btrim(F.regexp_replace(col(x), BLANK + "+", " "), F.lit(" "))
    return let(flat, lambda v: F.when(v == "", F.lit(None)).when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("…"))).otherwise(v))


def tier_of(kind: Column | str) -> Column:
    return F.when(col(kind).isin(*TIER_2), 2).when(col(kind).isin(*TYPES), 1)


def masking_for(kind: Column | str, tier: Column | str) -> Column:
    """How a detection is masked: tier 1 a black box, an email in part, others by a token."""
    return F.when(col(tier) == 1, "blackbox").when(col(kind) == "email", "partial").otherwise("token")


def partial_email(x: Column | str) -> Column:
    """The first letter and the last domain label stay; what has nothing before its last @ becomes [EMAIL]."""
    local = F.regexp_extract(col(x), r"^(.*)@[^@]*$", 1)
    return F.when(F.length(local) == 0, "[EMAIL]").otherwise(F.concat(F.substring(local, 1, 1), F.lit("***@***"), F.regexp_extract(col(x), r"(\.[^.@]*)$", 1)))


def replacement_for(kind: Column | str, tier: Column | str, token: Column | str, original: Column | str) -> Column:
    """What stands for a detection in the outgoing text."""
    return (
        F.when(col(tier) == 1, F.concat(F.lit("[REDACTED:"), F.upper(col(kind)), F.lit("]")))
        .when((col(kind) == "email") & blank_to_null(original).isNotNull(), partial_email(original))
        .otherwise(F.concat(F.lit("["), col(token), F.lit("]")))
    )


def token_key(kind: Column | str, content: Column | str, path: Column | str) -> Column:
    """What a token stands for: the type with the content's letters, digits, @ and dots, or the type at a path."""
    norm = F.regexp_replace(F.lower(col(content)), "[^a-z0-9@.]", "")
    return F.when(blank_to_null(content).isNotNull(), F.concat_ws(":", col(kind), norm)).otherwise(F.concat_ws("@", col(kind), col(path)))


def half_up(x: Column | str, places: int = 0) -> Column:
    """Rounds halves up, toward positive infinity, as browsers do: -2.5 becomes -2."""
    scale = float(10**places)
    return F.floor(col(x) * scale + 0.5) / scale


def is_marker(x: Column | str) -> Column:
    return col(x).rlike("^" + MARKER + r"\z")


def has_marker(x: Column | str) -> Column:
    return col(x).rlike(MARKER)


def is_stable_id(x: Column | str) -> Column:
    """An id fit for a selector: a name of at most 48 characters that isn't hex and has digits for half at most."""
    c = col(x)
    return F.coalesce(c.rlike(r"^[A-Za-z_][A-Za-z0-9_-]{0,47}\z") & ~c.rlike(r"^(?i)[0-9a-f]{8,}\z") & (F.regexp_count(c, F.lit("[0-9]")) * 2 <= F.length(c)), F.lit(False))


#: Addresses of browser pages, and of the extension stores.
BROWSER_PAGES = "^(?:chrome|edge|brave|about|devtools|chrome-extension|view-source|moz-extension):"
STORES = ("https://chrome.google.com/webstore", "https://chromewebstore.google.com")


def is_restricted_url(x: Column | str) -> Column:
    """Pages that must not be captured: none, browser pages, and the extension stores."""
    c = F.coalesce(col(x), F.lit(""))
    return (c == "") | c.rlike(BROWSER_PAGES) | c.startswith(STORES[0]) | c.startswith(STORES[1])


def host_label(url: Column | str) -> Column:
    """A page's host without www., or the text itself where it is no URL."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(col(url), F.lit("HOST")), "^www\\.", ""), col(url))


def elapsed_label(seconds: Column | str) -> Column:
    s = col(seconds)
    return F.when(s < 2, "now").when(s < 60, F.concat(half_up(s).cast("bigint").cast("string"), F.lit("s"))).otherwise(F.concat(half_up(s / 60).cast("bigint").cast("string"), F.lit("m")))


def masked_preview(x: Column | str, most: int = 12) -> Column:
    return F.repeat(F.lit("•"), F.least(F.length(col(x)), F.lit(most)))


def html_escape(x: Column | str) -> Column:
    out = F.replace(col(x), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def bar(value: Column | str, scale: Column | str, width: int) -> Column:
    """A bar of blocks; anything above nothing shows one."""
    n = F.coalesce(F.try_divide(col(value) * width, col(scale)), F.lit(0.0))
    return F.repeat(F.lit("█"), F.when(col(value) > 0, F.greatest(F.lit(1), F.bround(n, 0).cast("int"))).otherwise(F.lit(0)))


def data_url_mime(x: Column | str) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(col(x), "^data:([^;,]+)", 1)), F.lit("image/png"))


def data_url_bytes(x: Column | str) -> Column:
    return F.unbase64(F.element_at(F.split(col(x), ",", 2), -1))
