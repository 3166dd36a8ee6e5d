"""Splitting a posting body into blocks and naming their section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions.strings import count_of, first_of, let, string_array, strip, term_table

_HEADER = r"^(?:[-*]\s+)?([A-Za-z][A-Za-z0-9 &/'()-]{1,80}):?\s*$"


def split_blocks(body: Column) -> Column:
    parts = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), r"\n\s*\n")
    return F.filter(F.transform(parts, strip), lambda b: b != "")


def first_line(block: Column) -> Column:
    return first_of(F.split(block, r"\r\n|\n|\r", 2))


def looks_like_header(line: Column) -> Column:
    """One to six words, nothing but header characters, an optional colon."""
    matched = F.regexp_extract(strip(line), _HEADER, 1)
    return let(F.trim(matched), lambda m: (m != "") & F.size(F.split(m, " +")).between(1, 6))


def _by_header(line: Column, answers: dict[str, str]) -> Column:
    """Answer of the first label, in table order, one of whose phrases the header contains."""
    table = term_table(vocab.HEADER_PHRASES, {label: [answer] for label, answer in answers.items()})

    def first_label(header: Column) -> Column:
        hit = first_of(F.filter(table, lambda row: F.exists(row["terms"], lambda p: F.contains(header, p))))
        return first_of(hit["extra"])

    return let(F.lower(F.rtrim(strip(line), F.lit(":"))), first_label)


def header_label(line: Column) -> Column:
    """Label a header stands for, null when none."""
    return _by_header(line, {label: label for label in vocab.HEADER_PHRASES})


def classify_header(line: Column) -> Column:
    """Section a header announces, null when none."""
    return _by_header(line, vocab.LABEL_SECTION)


def section_phrases(section: str) -> list[str]:
    """Phrases that vote for a section: those of all labels that belong to it.

    Summary also takes the company label; logistics votes for requirements.
    """
    return [p for label, phrases in vocab.HEADER_PHRASES.items() if vocab.LABEL_SECTION[label] == section for p in phrases]


def assign_section(block: Column, is_first: Column) -> Column:
    """The section with most phrase hits (a matching header counts three), earliest section on ties."""
    announced = let(first_line(block), lambda line: F.when(looks_like_header(line), classify_header(line)))

    table = term_table({s: section_phrases(s) for s in vocab.SECTIONS})

    def votes(lowered: Column, header_section: Column) -> Column:
        return F.transform(
            table,
            lambda row: F.struct(
                (count_of(lowered, row["terms"]) + F.when(header_section == row["key"], 3).otherwise(0)).alias("votes"),
                row["rank"].alias("rank"),
                row["key"].alias("section"),
            ),
        )

    best = let(announced, lambda a: let(F.lower(block), lambda low: F.array_max(votes(low, a))))
    return let(
        best,
        lambda b: F.when(b["votes"] > 0, b["section"]).otherwise(
            F.when(is_first, F.lit("summary")).otherwise(F.lit("requirements"))
        ),
    )


def normalize_block(block: Column) -> Column:
    lines = F.transform(F.split(block, r"\r\n|\n|\r"), strip)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def section_order(section: Column) -> Column:
    return (F.array_position(string_array(vocab.SECTIONS), section) - 1).cast("int")
