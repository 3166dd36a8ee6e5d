"""Qualification predicates as Columns. Several are substring tests on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions.strings import UNICODE, contains_any, either, first_of, is_one_of, let, strip, text_of
from siftwork.functions.text import extract_yoe


def title_words(titles: Column) -> Column:
    """Distinct words of the preferred titles that say something about a role."""
    words = F.flatten(F.transform(titles, lambda t: F.split(F.lower(t), r"\s+")))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~is_one_of(w, vocab.TITLE_STOPWORDS)))


def title_matches(title: Column, words: Column) -> Column:
    """Does any preferred-title word occur in the title? ``words`` comes from ``title_words``."""
    return let(F.lower(text_of(title)), lambda low: F.exists(words, lambda w: F.contains(low, w)))


def contains_hard_no(text: Column, pattern: Column) -> Column:
    """Whole-word hit of any excluded keyword; ``pattern`` comes from ``any_word_pattern``."""
    return F.coalesce(F.rlike(F.lower(text_of(text)), pattern), F.lit(False))


def posted_within(posted_at: Column, days: Column, as_of: Column) -> Column:
    """Not older than ``days`` at ``as_of``; undated postings stay."""
    return posted_at.isNull() | (posted_at >= as_of - F.make_dt_interval(days))


def blocked_term(text: Column, any_pattern: Column, terms: Column, patterns: Column) -> Column:
    """The first blocklist term, in list order, found as a whole word; null when none.

    One alternation decides first, so the per-term scan runs only for hits.
    """

    def first_hit(low: Column) -> Column:
        hits = F.filter(
            F.arrays_zip(terms.alias("term"), patterns.alias("pattern")), lambda z: F.rlike(low, z["pattern"])
        )
        return F.when(F.rlike(low, any_pattern), F.lower(first_of(hits)["term"]))

    return let(F.lower(text), first_hit)


def yoe_reason(years: Column, min_yoe: Column, max_yoe: Column) -> Column:
    """``yoe_max: a > b`` or ``yoe_min: a < b`` for figures out of range; null when in range or absent."""

    def out_of_range(found: Column) -> Column:
        high, low = F.array_max(found), F.array_min(found)
        return F.when(
            high > max_yoe,
            F.concat(F.lit("yoe_max: "), high.cast("string"), F.lit(" > "), max_yoe.cast("string")),
        ).when(
            low < min_yoe,
            F.concat(F.lit("yoe_min: "), low.cast("string"), F.lit(" < "), min_yoe.cast("string")),
        )

    return let(years, out_of_range)


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def hiring_intent(text: Column, keywords: Column) -> Column:
    """Is a title or skill mentioned within 50 words of the first occurrence of a hiring phrase?"""
    return let(F.lower(text), lambda low: _hiring_intent(low, keywords))


def _hiring_intent(lowered: Column, keywords: Column) -> Column:
    half = vocab.HIRING_WINDOW_WORDS

    def near(signal: str, words: Column) -> Column:
        at = F.locate(signal, lowered)
        # Only the number of words before the phrase matters, not the words.
        count = F.regexp_count(F.substring(lowered, F.lit(1), at - 1), F.lit(r"\S+"))

        def window_has_keyword(before: Column) -> Column:
            begin = F.greatest(F.lit(0), before - half)
            end = F.least(F.size(words), before + half)
            window = F.array_join(F.slice(words, begin + 1, F.greatest(F.lit(0), end - begin)), " ")
            return let(window, lambda w: F.exists(keywords, lambda k: F.contains(w, F.lower(k))))

        return F.when(at > 0, let(count, window_has_keyword)).otherwise(False)

    def any_signal(words: Column) -> Column:
        found = F.lit(False)
        for signal in vocab.HIRING_SIGNALS:
            found = found | near(signal, words)
        return found

    # Most texts hold no signal at all and are not split into words.
    searched = F.when(contains_any(lowered, vocab.HIRING_SIGNALS), let(_words(lowered), any_signal))
    return F.coalesce(searched, F.lit(False))


def requires_advanced_degree(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in vocab.DEGREE_PATTERNS))


_STATE_CODE = UNICODE + r"(?:,\s*|;\s*|\|\s*|\b)" + either(vocab.US_STATE_CODES) + r"\b"
_CITY_WORD = UNICODE + r"\b" + either(vocab.US_CITIES) + r"\b"
_US_WORD = UNICODE + r"\bUS\b"


def _us_country(lowered: Column) -> Column:
    return F.contains(lowered, F.lit("united states")) | F.contains(lowered, F.lit(" usa"))


def _us_signal(text: Column, lowered: Column) -> Column:
    return (
        _us_country(lowered)
        | text.rlike(_US_WORD)
        | text.rlike(_STATE_CODE)
        | contains_any(lowered, vocab.US_STATE_NAMES)
        | lowered.rlike(_CITY_WORD)
    )


def is_us_location(location: Column) -> Column:
    """Is a location field in the US, remote, or unspecified? Foreign places win over "remote"."""

    def judged(loc: Column) -> Column:
        return let(
            F.lower(loc),
            lambda low: F.when(is_one_of(low, vocab.LOCATION_PLACEHOLDERS), True)
            .when(contains_any(low, vocab.NON_US_PLACES), False)
            .when(F.contains(low, F.lit("remote")), True)
            .otherwise(_us_signal(loc, low)),
        )

    return let(strip(text_of(location)), judged)


def us_or_remote_text(text: Column) -> Column:
    """The same question for free text: remote without a foreign place, or any US signal."""
    return let(F.lower(text), lambda low: _us_or_remote(text, low))


def _us_or_remote(text: Column, low: Column) -> Column:
    remote_only = F.contains(low, F.lit("remote")) & ~contains_any(low, vocab.NON_US_PLACES_IN_TEXT)
    return remote_only | _us_signal(text, low)


def effective_location(location: Column, workplace_type: Column) -> Column:
    """"Remote" for remote work without a foreign place in the location field."""
    foreign = contains_any(F.lower(text_of(location)), vocab.NON_US_PLACES)
    return F.when((text_of(workplace_type) == "remote") & ~foreign, F.lit("Remote")).otherwise(location)


def filter_reason(
    source: Column, title: Column, text: Column, location: Column,
    *, block_any: Column, block_terms: Column, block_patterns: Column,
    min_yoe: Column, max_yoe: Column, intent_keywords: Column, degree_filter: Column,
) -> Column:
    """The first rule a posting breaks, as text; empty when it passes all of them."""
    structured = is_one_of(source, vocab.STRUCTURED_SOURCES)
    is_thread = source == "hackernews"
    searched = F.when(structured, title).otherwise(F.concat(title, F.lit(" "), text))
    blocked = blocked_term(searched, block_any, block_terms, block_patterns)
    located = (
        F.when(structured, is_us_location(location)).when(is_thread, us_or_remote_text(text)).otherwise(True)
    )
    return F.coalesce(
        F.concat(F.lit("title_blocklist: "), blocked),
        yoe_reason(extract_yoe(text), min_yoe, max_yoe),
        F.when(is_thread & ~hiring_intent(text, intent_keywords), "hiring_intent_not_found"),
        F.when(F.coalesce(degree_filter, F.lit(False)) & requires_advanced_degree(text), "degree_required"),
        F.when(~located, "non_us_location"),
        F.lit(""),
    )
