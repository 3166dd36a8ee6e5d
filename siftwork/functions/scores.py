"""Lexical and dimension scores as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions.strings import UNICODE, empty_strings, is_one_of, let, string_array, strip, text_of
from siftwork.functions.text import normalize_title


def keyword_prescore(title: Column, raw_text: Column, titles: Column, skills: Column) -> Column:
    """1.0 for a preferred title, else the share of skills the text mentions, 0.0 without skills."""

    def is_wanted(normalized: Column) -> Column:
        return F.exists(
            titles,
            lambda t: (F.lower(title) == F.lower(t))
            | let(normalize_title(t), lambda n: (n != "") & F.contains(normalized, n)),
        )

    found = let(F.lower(raw_text), lambda text: F.size(F.filter(skills, lambda s: F.contains(text, F.lower(s)))))
    return (
        F.when(let(normalize_title(title), is_wanted), F.lit(1.0))
        .when(F.size(skills) > 0, found.cast("double") / F.size(skills))
        .otherwise(F.lit(0.0))
    )


def gate_flag(qualified: Column, reason: Column, prescore: Column) -> Column:
    """Why a posting needs no expensive score; null when it does."""
    return F.when(~qualified, F.concat(F.lit("scrape_filtered: "), text_of(reason))).when(
        prescore < vocab.PRESCORE_GATE, F.lit("no skill overlap")
    )


def fit_score(dims: dict[str, Column], weights: dict[str, Column], disqualified: Column) -> Column:
    """Weighted sum of the six dimensions on 0..100, ties to even; 0 when disqualified."""
    total = None
    for name in vocab.DIMENSIONS:
        part = F.coalesce(dims[name], F.lit(0)) * weights[name]
        total = part if total is None else total + part
    scaled = F.least(F.lit(100), F.rint(total * F.lit(10.0)).cast("int"))
    return F.when(F.coalesce(disqualified, F.lit(False)), F.lit(0)).otherwise(scaled)


def ats_score(raw_text: Column, resume: Column, skills: Column) -> tuple[Column, Column]:
    """(score, missing skills): how far the resume covers the words and skills of a posting."""
    wanted = F.transform(F.coalesce(skills, empty_strings()), F.lower)

    def word_share(text: Column, cv: Column) -> Column:
        words = F.array_except(
            F.array_distinct(
                F.regexp_extract_all(text, F.lit(UNICODE + r"\b[a-z][a-z0-9+#.\-]{2,}\b"), F.lit(0))
            ),
            string_array(vocab.ATS_STOPWORDS),
        )
        return let(
            words,
            lambda ws: F.when(
                F.size(ws) > 0, F.size(F.filter(ws, lambda w: F.contains(cv, w))).cast("double") / F.size(ws)
            ).otherwise(0.0),
        )

    def skill_share(text: Column, cv: Column) -> Column:
        both = F.size(F.filter(wanted, lambda s: F.contains(text, s) & F.contains(cv, s))).cast("double")
        return F.when(F.size(wanted) > 0, both / F.size(wanted)).otherwise(0.0)

    def score(text: Column, cv: Column) -> Column:
        share = word_share(text, cv) * 0.6 + skill_share(text, cv) * 0.4
        return F.least(F.lit(100), F.floor(share * 100).cast("int"))

    def misses(text: Column, cv: Column) -> Column:
        return F.slice(F.filter(wanted, lambda s: F.contains(text, s) & ~F.contains(cv, s)), 1, 5)

    def lowered(body) -> Column:
        return let(F.lower(raw_text), lambda text: let(F.lower(text_of(resume)), lambda cv: body(text, cv)))

    return lowered(score), lowered(misses)


# ---- responses -----------------------------------------------------------------------------

def strip_fences(raw: Column) -> Column:
    """A response without the Markdown code fences around it."""
    opened = F.regexp_replace(strip(raw), r"(?m)^```(?:json)?\s*", "")
    return strip(F.regexp_replace(opened, r"(?m)\s*```$", ""))


def _unwrap_once(json: Column) -> Column:
    keys = F.json_object_keys(json)
    is_wrapper = let(keys, lambda k: (F.size(k) == 1) & (F.get(k, F.lit(0)) == "value"))
    # Most values are no objects and are not parsed at all.
    may_wrap = F.startswith(json, F.lit("{"))
    return F.when(may_wrap & is_wrapper, F.get_json_object(json, "$.value")).otherwise(json)


def unwrap_value(json: Column) -> Column:
    """Content of nested one-key ``{"value": x}`` objects, however deep: one round per ``value`` in the text."""

    def unwrapped(text: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.greatest(F.regexp_count(text, F.lit('"value"')), F.lit(1)))
        inner = F.aggregate(rounds, text, lambda inside, _: let(inside, _unwrap_once))
        return F.when(F.startswith(text, F.lit("{")), inner).otherwise(text)

    return let(json, unwrapped)


def clamp_dimension(text: Column) -> Column:
    """0..10; text that is no whole number counts 0."""
    return F.coalesce(_in_range(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), strip(text)).try_cast("double")), F.lit(0))


def _in_range(number: Column) -> Column:
    """0..10 towards zero; null stays null, which ``greatest`` and ``least`` would skip."""
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), number)).cast("int"))


def _dimension(json: Column, value: Column, name: str) -> Column:
    """A JSON number is cut towards zero and true is 1; quoted text must be a whole number."""
    quoted = json.rlike(rf'"{name}"\s*:\s*(?:\{{\s*"value"\s*:\s*)*"')
    bare = F.coalesce(_in_range(value.try_cast("double")), (value == "true").cast("int"), F.lit(0))
    return F.when(quoted, clamp_dimension(value)).otherwise(bare)


def _strings(json: Column) -> Column:
    items = F.from_json(json, "array<string>")
    return F.coalesce(F.transform(items, lambda x: text_of(unwrap_value(x))), empty_strings())


def parse_response(raw: Column) -> Column:
    """A scoring response as a struct; null when the text holds no JSON object.

    Dimensions are clamped to 0..10 and zero when disqualified; at most four reasons are kept.
    """
    return let(unwrap_value(strip_fences(raw)), _parsed)


def _parsed(json: Column) -> Column:
    # One parse for all fields, then one pass that unwraps every value.
    fields = F.transform_values(F.from_json(json, "map<string,string>"), lambda k, v: unwrap_value(v))

    def result(values: Column) -> Column:
        def at(name: str) -> Column:
            return F.try_element_at(values, F.lit(name))

        out = F.coalesce(is_one_of(F.lower(at("disqualified")), ["true", "1", "yes"]), F.lit(False))

        def filled_in(is_out: Column) -> Column:
            reason = F.coalesce(at("disqualify_reason"), F.when(is_out, "unknown disqualifier").otherwise(""))
            return F.struct(
                is_out.alias("disqualified"),
                reason.alias("disqualify_reason"),
                *[F.when(is_out, 0).otherwise(_dimension(json, at(d), d)).alias(d) for d in vocab.DIMENSIONS],
                F.slice(_strings(at("reasons")), 1, 4).alias("reasons"),
                _strings(at("flags")).alias("flags"),
                text_of(at("one_liner")).alias("one_liner"),
            )

        return let(out, filled_in)

    return F.when(F.json_object_keys(json).isNotNull(), let(fields, result))


def _as_json(raw: Column) -> Column:
    """Text as JSON; a single-quoted object with True/False/None is rewritten to JSON first."""
    text = strip(raw)
    is_json = F.json_object_keys(text).isNotNull() | F.json_array_length(text).isNotNull()
    as_double = F.regexp_replace(
        F.regexp_replace(text, r'([\[{,:]\s*)\'((?:[^\'\\]|\\.)*)\'(?=\s*[\]},:])', r'$1"$2"'),
        r"([\[{,:]\s*)(True|False|None)(?=\s*[\]},])", "$1<$2>",
    )
    literal = as_double
    for word, json in (("<True>", "true"), ("<False>", "false"), ("<None>", "null")):
        literal = F.replace(literal, F.lit(word), F.lit(json))
    return F.when(is_json, text).otherwise(literal)


def recover_generation(payload: Column) -> Column:
    """Fields of a failed tool call as a JSON map, from ``[{"name", "parameters"}]`` or inline fields.

    Null when there is nothing to recover.
    """
    return let(_as_json(payload), _recovered)


def _recovered(json: Column) -> Column:
    is_list = F.json_array_length(json).isNotNull()
    head = F.when(is_list, F.get_json_object(json, "$[0]")).otherwise(json)

    def picked(fields: Column, params: Column) -> Column:
        inline = F.when(is_list, F.map_filter(fields, lambda k, v: k != "name")).otherwise(fields)
        has_params = F.coalesce(F.size(params), F.lit(0)) > 0
        in_dict = ~is_list & F.map_contains_key(fields, F.lit("parameters"))
        return F.when(has_params | in_dict, params).otherwise(inline)

    chosen = let(
        head,
        lambda h: let(
            F.from_json(h, "map<string,string>"),
            lambda fields: let(
                F.from_json(F.get_json_object(h, "$.parameters"), "map<string,string>"),
                lambda params: picked(fields, params),
            ),
        ),
    )
    unwrapped = F.transform_values(chosen, lambda k, v: unwrap_value(v))
    return let(unwrapped, lambda m: F.when(F.size(m) > 0, m))


def cost_estimate(provider: Column, n: Column) -> Column:
    dollars = F.format_number(n * F.lit(vocab.COST_PER_POSTING), 2)
    return F.when(
        provider.isin(vocab.PAID_PROVIDERS), F.concat(F.lit("~$"), F.replace(dollars, F.lit(","), F.lit("")))
    ).otherwise(F.lit("~$0.00 (free tier)"))


