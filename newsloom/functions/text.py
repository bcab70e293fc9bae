"""Column functions on text: keys for de-duplication, relevance, source weights and lexicon sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The results depend on these patterns, weights and word lists.
SUFFIX = r"(?U)\s*[-–|]\s*[A-Za-z][\w\s\.&]{1,40}$"  # noqa: RUF001
SOURCE_WEIGHTS = "reuters:1.25,bloomberg:1.25,cnbc:1.1,benzinga:0.95,mock:0.1"
POSITIVE = ("beat", "surge", "bullish", "growth", "strong", "upgrade", "outperform", "profit", "record")
NEGATIVE = ("miss", "drop", "bearish", "decline", "weak", "downgrade", "underperform", "loss", "lawsuit")


def or_default(x: Column, default: Column | str) -> Column:
    """``x``, or the default where it is null or empty."""
    return F.coalesce(F.when(x != "", x), default if isinstance(default, Column) else F.lit(default))


def strip_all(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9 ]", " "), r"\s+", " "))


def strip_source_suffix(x: Column) -> Column:
    """Without a publisher's name after a dash or bar at the end; spaces around the dash are optional, so hyphenated tails go too."""
    return strip_all(F.regexp_replace(x, SUFFIX, ""))


def dedup_key(headline: Column) -> Column:
    """Two headlines with the same key are one story; the source plays no part."""
    return normalize_text(strip_source_suffix(F.coalesce(headline, F.lit(""))))


def source_weights(spec: str = SOURCE_WEIGHTS) -> dict[str, float]:
    """``name:weight,...`` as a dict; items without a colon or a number are skipped."""
    out = {}
    for item in spec.split(","):
        name, colon, value = item.partition(":")
        try:
            if colon:
                out[" ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789 " else " " for c in name.lower()).split())] = float(value)
        except ValueError:
            continue
    return out


def source_weight(source: Column, spec: str = SOURCE_WEIGHTS) -> Column:
    """The weight of a source by its normalised name, 1.0 if it has none."""
    pairs = [F.lit(x) for kv in source_weights(spec).items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), normalize_text(source)), F.lit(1.0)) if pairs else F.lit(1.0)


def relevance(ticker: Column, headline: Column, summary: Column, symbols: Column) -> Column:
    """How much an article is about a ticker, 0 to 1, from its tags and where the ticker is mentioned."""
    low = F.lower(ticker)
    in_head = F.lower(F.coalesce(headline, F.lit(""))).contains(low)
    in_summary = F.lower(F.coalesce(summary, F.lit(""))).contains(low)
    n = F.coalesce(F.size(symbols), F.lit(0))

    def part(when: Column, value: float) -> Column:
        return F.when(when, F.lit(value)).otherwise(F.lit(0.0))

    score = part(F.coalesce(F.array_contains(symbols, F.upper(ticker)), F.lit(False)), 0.45) + part(in_head, 0.35) + part(in_summary, 0.15)
    score = score - F.when(n > 0, F.least(F.lit(0.25), F.lit(0.04) * (n - 1).cast("double"))).otherwise(F.lit(0.0))
    score = score + part(in_head | in_summary, 0.05)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def lexicon_compound(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(p - n) / max(p + n, 1) of how many distinct words of each list the text contains, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    p, n = (sum((low.contains(w).cast("int") for w in words), F.lit(0)) for words in (positive, negative))
    return (p - n).cast("double") / F.greatest(p + n, F.lit(1)).cast("double")


def sentiment_label(compound: Column) -> Column:
    return F.when(compound > 0.05, "POSITIVE").when(compound < -0.05, "NEGATIVE").otherwise("NEUTRAL")


def sentiment_parts(compound: Column) -> dict[str, Column]:
    """Positive, negative and neutral shares of a compound score."""
    zero = F.lit(0.0)
    return {"score_positive": F.greatest(zero, compound), "score_negative": F.greatest(zero, -compound), "score_neutral": F.greatest(zero, F.lit(1.0) - F.abs(compound))}


def three_class(positive: Column, negative: Column, neutral: Column) -> tuple[Column, Column]:
    """Compound (p - n, clamped) and label (the largest; ties positive, then negative) of three probabilities."""
    compound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), positive - negative))
    label = F.when((positive >= negative) & (positive >= neutral), "POSITIVE").when(negative >= neutral, "NEGATIVE").otherwise("NEUTRAL")
    return compound, label


def has_text_signal(headline: Column, summary: Column, ticker: Column, company: Column | None = None) -> Column:
    """Whether the ticker or the company's name is in the text, in any case."""
    text = F.lower(F.concat_ws(" ", F.coalesce(headline, F.lit("")), F.coalesce(summary, F.lit(""))))
    found = text.contains(F.lower(ticker))
    return found if company is None else found | F.coalesce(text.contains(F.lower(company)) & (company != ""), F.lit(False))


def signal_label(label: Column) -> Column:
    """BUY, SELL and HOLD as RISE, FALL and STABLE; other labels in upper case; none is STABLE."""
    up = F.upper(or_default(label, "STABLE"))
    return F.when(up == "BUY", "RISE").when(up == "SELL", "FALL").when(up == "HOLD", "STABLE").otherwise(up)


def csv_list(x: Column, upper: bool = False) -> Column:
    """Items of a comma-separated setting, trimmed, without empty ones."""
    items = F.filter(F.transform(F.split(x, ","), lambda v: F.trim(v)), lambda v: v != "")
    return F.transform(items, F.upper) if upper else items


def search_queries(ticker: Column, company: Column, sources: Sequence[str]) -> Column:
    """Queries for a news search: one plain, and one for each site."""
    terms = F.array_distinct(F.filter(F.array(ticker, company), lambda v: v.isNotNull() & (v != "")))
    base = F.concat(F.lit("("), F.array_join(terms, " OR "), F.lit(")"))
    return F.array(F.concat(base, F.lit(" stock")), *[F.concat(base, F.lit(f" site:{s}")) for s in sources])


def query_url(base: str, query: Column) -> Column:
    """``base`` with the query quoted for an address: letters, digits and ``_.-~`` stay, a space is a plus."""
    return F.concat(F.lit(base), F.replace(F.replace(F.url_encode(query), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def fixed(x: Column, places: int = 2) -> Column:
    """A number with so many places, no grouping; none is 0."""
    return F.format_string(f"%.{places}f", F.coalesce(x.cast("double"), F.lit(0.0)))


def percent(x: Column, places: int = 2) -> Column:
    """A share in per cent."""
    return F.concat(fixed(F.coalesce(x.cast("double"), F.lit(0.0)) * 100, places), F.lit("%"))


def _lexicon_engine(headline: Column, summary: Column) -> Column:
    return lexicon_compound(F.concat(F.coalesce(headline, F.lit("")), F.lit(". "), F.coalesce(summary, F.lit(""))))


#: Sentiment engines by name: functions of headline and summary that give a compound score as a column.
ENGINES: dict = {"lexicon": _lexicon_engine}


def register_engine(name: str, score) -> None:
    """Makes ``score(headline, summary) -> Column`` (built-in functions, or a pandas UDF for a model) known by a name."""
    ENGINES[name.lower()] = score


def engine(name: str):
    """The engine of that name; the lexicon where there is none."""
    return ENGINES.get((name or "").lower(), _lexicon_engine)
