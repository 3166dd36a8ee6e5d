"""Text scalars: ids, dates, experience, context extraction, snippets, labels. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions.strings import (
    UNICODE,
    dedupe_ignoring_case,
    empty_strings,
    filled,
    first_of,
    guarded,
    is_one_of,
    let,
    lookup,
    strip,
    text_of,
    title_case,
)


# ---- ids and slugs -------------------------------------------------------------------------


def make_id(source: Column | str, source_id: Column) -> Column:
    prefix = F.lit(source) if isinstance(source, str) else source
    return F.concat(text_of(prefix), F.lit("_"), text_of(source_id.cast("string")))


def normalize_title(c: Column) -> Column:
    """Lower case, everything but letters and digits collapsed to single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def sanitize_slug(c: Column) -> Column:
    return F.regexp_replace(F.replace(strip(F.lower(c)), F.lit(" "), F.lit("_")), UNICODE + r"[^\w]", "")


def company_slug(c: Column) -> Column:
    dashed = F.replace(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("-")), F.lit("."), F.lit(""))
    squeezed = F.regexp_replace(F.regexp_replace(dashed, UNICODE + r"[^\w-]", ""), "-+", "-")
    return F.btrim(squeezed, F.lit("-"))


def slug_candidates(name: Column, domain: Column) -> Column:
    """Board names worth trying for a company, best guess first, as an array."""
    clean = strip(F.regexp_replace(F.lower(text_of(name)), UNICODE + r"[^\w\s-]", ""))

    def spelled(c: Column, *joins: str) -> list[Column]:
        return [F.replace(c, F.lit(" "), F.lit(j)) for j in joins]

    guesses = [F.lower(first_of(F.split(text_of(domain), r"\.")))] + spelled(clean, "", "-", "_")
    for suffix in vocab.SLUG_SUFFIXES:
        shorter = strip(F.replace(clean, F.lit(suffix), F.lit("")))
        guesses += [F.when(shorter != clean, g).otherwise("") for g in spelled(shorter, "", "-")]
    return F.array_distinct(F.filter(F.array(*guesses), lambda g: g != ""))


def model_slug(c: Column) -> Column:
    cleaned = F.btrim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")), F.lit("_"))
    return F.coalesce(filled(cleaned), F.lit("model"))


def chunk_uid(job_id: Column, chunk_key: Column, model_name: Column) -> Column:
    return F.concat_ws(":", job_id, chunk_key, model_slug(model_name))


# ---- dates, numbers ------------------------------------------------------------------------


def parse_posted_at(c: Column) -> Column:
    """Epoch seconds, epoch milliseconds or ISO-8601 text as a timestamp; null when neither."""
    text = strip(c.cast("string"))
    number = F.when(text.rlike(r"^\d+(\.\d+)?$"), text).try_cast("double")
    seconds = F.when(number > vocab.EPOCH_MILLIS_ABOVE, number / 1000.0).otherwise(number)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), text)
    return F.coalesce(
        F.timestamp_micros((F.when(seconds < 253402300800.0, seconds) * 1000000.0).cast("bigint")),
        F.to_timestamp(iso.try_cast("timestamp")),
    )


_YOE = "(?i)(?:" + "|".join(vocab.YOE_PATTERNS) + ")"


def extract_yoe(c: Column) -> Column:
    """Years-of-experience figures in reading order; a range counts with its upper end.

    The five patterns form one alternation in order, so one left-to-right scan already
    yields the non-overlapping matches.
    """
    matches = F.regexp_extract_all(c, F.lit(_YOE), F.lit(0))
    highest = F.transform(
        matches,
        lambda m: F.array_max(
            F.transform(F.regexp_extract_all(m, F.lit(r"(\d+)"), F.lit(1)), lambda d: d.try_cast("bigint"))
        ),
    )
    return F.array_compact(highest)


def parse_money(c: Column) -> Column:
    """Whole currency units from ``$120,000``-like text; null otherwise."""
    text = strip(F.regexp_replace(c.cast("string"), r"[$,]", ""))
    return F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast("bigint")


# ---- posting text --------------------------------------------------------------------------


def raw_text_header(title: Column, company: Column, location: Column, url: Column) -> Column:
    return F.concat(
        F.lit("Title: "), text_of(title), F.lit("\nCompany: "), text_of(company), F.lit("\nLocation: "),
        text_of(location), F.lit("\nURL: "), text_of(url), F.lit("\n\nDescription:\n"),
    )


def build_raw_text(
    title: Column, company: Column, location: Column, url: Column, description: Column,
    max_chars: int = vocab.RAW_TEXT_CHARS,
) -> Column:
    """Labelled header lines plus description, reduced to the relevant paragraphs."""
    header = raw_text_header(title, company, location, url)
    return extract_job_context(strip(F.concat(header, text_of(description))), max_chars)


def paragraph_priority(paragraph: Column) -> Column:
    """Index of the first paragraph class whose pattern occurs, or one past the last class."""
    def first_class(text: Column) -> Column:
        chain = None
        for i, pattern in enumerate(vocab.PARAGRAPH_PATTERNS):
            hit = text.rlike(guarded(pattern))
            chain = F.when(hit, i) if chain is None else chain.when(hit, i)
        return chain.otherwise(len(vocab.PARAGRAPH_PATTERNS))

    return let(F.lower(paragraph), first_class)


def extract_job_context(c: Column, max_chars: int = vocab.RAW_TEXT_CHARS) -> Column:
    """The paragraphs that matter most, in document order, within ``max_chars``.

    Paragraphs are taken by class, then position, while they fit. One of the first three
    classes that does not fit is cut to the remaining room and ends the selection.
    """
    unix = F.replace(text_of(c), F.lit("\r\n"), F.lit("\n"))
    return let(unix, lambda text: _reduced(text, max_chars))


def _reduced(text: Column, max_chars: int) -> Column:
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda p: p != "")
    ranked = F.array_sort(
        F.transform(
            paragraphs,
            lambda p, i: F.struct(
                paragraph_priority(p).alias("priority"), i.alias("pos"), p.alias("body"), F.length(p).alias("n")
            ),
        )
    )
    start = F.struct(
        F.lit(0).alias("used"),
        F.lit(False).alias("full"),
        F.array().cast("array<struct<pos:int,body:string>>").alias("kept"),
    )

    def take(acc: Column, p: Column) -> Column:
        used, kept = acc["used"], acc["kept"]
        room = F.lit(max_chars) - used - 4

        def keep(body: Column) -> Column:
            return F.concat(kept, F.array(F.struct(p["pos"].alias("pos"), body.alias("body"))))

        fits = ~acc["full"] & (used + p["n"] + 1 <= max_chars)
        cut = ~acc["full"] & (p["priority"] <= 2) & (used < max_chars - 200)
        return (
            F.when(fits, F.struct((used + p["n"] + 1).alias("used"), F.lit(False).alias("full"), keep(p["body"]).alias("kept")))
            .when(
                cut,
                F.struct(
                    F.lit(max_chars).alias("used"),
                    F.lit(True).alias("full"),
                    keep(F.concat(F.substring(p["body"], F.lit(1), room), F.lit("..."))).alias("kept"),
                ),
            )
            .otherwise(acc)
        )

    chosen = F.aggregate(
        ranked, start, take,
        lambda acc: F.array_join(F.transform(F.array_sort(acc["kept"]), lambda k: k["body"]), "\n\n"),
    )
    head, tail = int(max_chars * 0.6), int(max_chars * 0.4)
    ends = F.concat(F.substring(text, 1, head), F.lit("\n\n...\n\n"), F.right(text, F.lit(tail)))
    return (
        F.when(F.length(text) <= max_chars, F.when(strip(text) == "", F.lit("")).otherwise(text))
        .when(~text.rlike(r"\S"), F.lit(""))
        .otherwise(let(chosen, lambda kept: F.when(kept != "", kept).otherwise(ends)))
    )


def metadata_field(raw_text: Column, label: str) -> Column:
    """Value of a ``Label: value`` header line, null when there is none."""
    return filled(strip(F.regexp_extract(raw_text, rf"(?m)^{label}:\s*(.+)$", 1)))


def description_body(raw_text: Column) -> Column:
    """What follows the first ``Description:`` line, else the whole text."""
    marker = "\nDescription:\n"
    at = F.locate(marker, raw_text)
    return strip(F.when(at > 0, F.substring(raw_text, at + len(marker), F.length(raw_text))).otherwise(raw_text))


# ---- terms and snippets --------------------------------------------------------------------


def query_terms(c: Column) -> Column:
    found = F.regexp_extract_all(text_of(c), F.lit(r"[A-Za-z][A-Za-z0-9+#./-]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~is_one_of(F.lower(t), vocab.QUERY_STOPWORDS))


def flat_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), strip), lambda s: s != ""), " ")


def snippet(chunk_text: Column, terms: Column, max_chars: int = 160, lead: int = 45) -> Column:
    """A window around the first term that occurs, or the head of the text."""
    found = let(
        flat_lines(chunk_text),
        lambda flat: F.struct(
            flat.alias("flat"),
            F.length(flat).alias("size"),
            let(
                F.lower(flat),
                lambda low: let(
                    first_of(F.filter(terms, lambda t: F.contains(low, F.lower(t)))),
                    lambda term: F.position(F.lower(term), low) - 1,
                ),
            ).alias("at"),
        ),
    )

    def cut(f: Column) -> Column:
        flat, size = f["flat"], f["size"]
        begin = F.greatest(F.lit(0), f["at"] - lead)
        end = F.least(size, f["at"] + (max_chars - lead))
        window = strip(F.substring(flat, begin + 1, end - begin))
        around = F.when((begin > 0) | (end < size), F.concat(F.lit("..."), window, F.lit("..."))).otherwise(window)
        head = strip(F.substring(flat, 1, max_chars))
        return F.when(f["at"].isNotNull(), around).otherwise(
            F.when(size > max_chars, F.concat(head, F.lit("..."))).otherwise(head)
        )

    return let(found, cut)


def prepare_chunk_text(c: Column, max_chars: int = vocab.RERANK_CHUNK_CHARS) -> Column:
    """Header lines kept, the rest flattened and cut at a word end, for a length-limited scorer."""
    def to_word_end(s: Column) -> Column:
        return strip(F.regexp_replace(s, r" [^ ]*$", ""))

    def assembled(headers: Column, lines: Column) -> Column:
        body = F.array_join(F.filter(lines, lambda s: ~F.array_contains(headers, s)), " ")

        def with_prefix(prefix: Column) -> Column:
            room = F.lit(max_chars - 1) - F.least(F.length(prefix), F.lit(max_chars // 3))
            return F.when(
                prefix != "", strip(F.concat(prefix, F.lit("\n"), to_word_end(F.substring(body, F.lit(1), room))))
            ).otherwise(to_word_end(F.substring(body, 1, max_chars)))

        return let(F.array_join(headers, "\n"), with_prefix)

    def shortened(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), strip), lambda s: s != "")
        headers = let(
            lines,
            lambda ls: let(
                F.filter(F.slice(ls, 1, 4), lambda s: F.contains(s, F.lit(":"))), lambda hs: assembled(hs, ls)
            ),
        )
        return F.when(F.length(text) <= max_chars, text).otherwise(headers)

    return let(strip(text_of(c)), shortened)


def dedupe_preserve_order(arr: Column) -> Column:
    return dedupe_ignoring_case(arr)


# ---- labels --------------------------------------------------------------------------------


def summarize_errors(errors: Column, preview_chars: int = 72) -> Column:
    n = F.size(F.coalesce(errors, empty_strings()))
    first = strip(first_of(errors))
    short = F.when(
        F.length(first) > preview_chars,
        F.concat(F.regexp_replace(F.substring(first, 1, preview_chars - 1), r"\s+$", ""), F.lit("…")),
    ).otherwise(first)
    return (
        F.when(n == 0, F.lit("None"))
        .when(n == 1, short)
        .otherwise(F.concat(short, F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)")))
    )


def score_state(fit: Column, attempts: Column, error: Column) -> Column:
    return (
        F.when(fit.isNotNull(), "Scored")
        .when(F.coalesce(attempts, F.lit(0)) >= vocab.MAX_SCORE_ATTEMPTS, "Failed")
        .when(text_of(error) != "", "Needs retry")
        .otherwise("Pending")
    )


def source_label(source: Column) -> Column:
    own = title_case(F.replace(source, F.lit("_"), F.lit(" ")))
    return F.coalesce(lookup(vocab.SOURCE_LABELS, source), own)


def status_label(status: Column) -> Column:
    return title_case(status)


def disqualified_signal(disqualified: Column, reason: Column, flags: Column) -> tuple[Column, Column]:
    """(disqualified, reason): the stored pair, or what an older ``disqualified:`` flag says."""
    stored, why = F.coalesce(disqualified, F.lit(False)), text_of(reason)
    flag = first_of(F.filter(F.coalesce(flags, empty_strings()), lambda f: F.startswith(f, F.lit("disqualified:"))))
    use_flag = ~stored & (why == "") & flag.isNotNull()
    from_flag = strip(F.substring(flag, F.lit(len("disqualified:") + 1), F.length(flag)))
    return F.when(use_flag, True).otherwise(stored), F.when(use_flag, from_flag).otherwise(why)


def match_band(fit: Column) -> Column:
    return (
        F.when(fit >= 85, "excellent").when(fit >= 70, "strong").when(fit >= 55, "fair").otherwise("weak")
    )
