"""Landed job-board payloads to one posting schema.

Raw rows are (profile, source, company, fetched_at, payload). ``normalize_all`` reads them in one pass: a payload
is parsed once into a VARIANT, its postings are picked by source and exploded once, and each posting is taken
out of the variant with its source's schema. The normalizers of single sources parse with those schemas directly.
A normalized row has

    profile, source, id, title, company, location, filter_location, url, description,
    full_text, raw_text, posted_at, fetched_at

where ``full_text`` and ``filter_location`` are what the qualification rules read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions.html import strip_html
from siftwork.functions.predicates import effective_location
from siftwork.functions.strings import filled, remembered, strip, text_of
from siftwork.functions.text import extract_job_context, make_id, parse_posted_at, raw_text_header

NORMALIZED = [
    "profile", "source", "id", "title", "company", "location", "filter_location", "url", "description", "full_text",
    "raw_text", "posted_at", "fetched_at",
]

_GREENHOUSE_POSTING = (
    "struct<id:string,title:string,updated_at:string,location:struct<name:string>,"
    "absolute_url:string,content:string,description:string>"
)
GREENHOUSE = f"struct<jobs:array<{_GREENHOUSE_POSTING}>>"
_LEVER_POSTING = (
    "struct<id:string,text:string,createdAt:string,categories:struct<location:string>,workplaceType:string,"
    "hostedUrl:string,description:string,lists:array<struct<content:string>>>"
)
LEVER = f"array<{_LEVER_POSTING}>"
THREAD = (
    "struct<hits:array<struct<objectID:string,title:string,author:string,created_at_i:bigint>>,"
    "id:bigint,kids:array<bigint>,text:string>"
)
_ASHBY_POSTING = (
    "struct<id:string,title:string,location:string,locationName:string,"
    "secondaryLocations:array<struct<location:string>>,jobUrl:string,descriptionHtml:string,descriptionPlain:string,"
    "publishedAt:string,publishedDate:string,isListed:boolean>"
)
ASHBY = f"struct<jobs:array<{_ASHBY_POSTING}>,jobPostings:array<{_ASHBY_POSTING}>>"
_WORKABLE_PLACE = "struct<city:string,region:string,state:string,country:string>"
_WORKABLE_POSTING = (
    "struct<id:string,shortcode:string,title:string,city:string,state:string,country:string,telecommuting:boolean,"
    f"location:{_WORKABLE_PLACE},locations:array<{_WORKABLE_PLACE}>,url:string,shortlink:string,"
    "application_url:string,description:string,published_on:string,created_at:string,department:string,"
    "employment_type:string,experience:string,education:string,function:string,industry:string>"
)
WORKABLE = f"struct<jobs:array<{_WORKABLE_POSTING}>,results:array<{_WORKABLE_POSTING}>>"
_HIMALAYAS_POSTING = (
    "struct<id:string,guid:string,title:string,companyName:string,company:string,location:string,"
    "locationRestrictions:array<string>,applicationLink:string,url:string,description:string,pubDate:string>"
)
HIMALAYAS = f"struct<jobs:array<{_HIMALAYAS_POSTING}>>"

# What a source contributes before any text is built. A posting's text is either ``plain``, or
# ``html`` to be stripped, followed by ``extras``; a null title is the first line of the text.
def exploded(raw: DataFrame, source: str, schema: str, items) -> DataFrame:
    """Raw rows of one source with one row per posting, in the struct column ``p``."""
    parsed = raw.where(F.col("source") == source).withColumn("j", F.from_json("payload", schema))
    return parsed.select("profile", F.col("company").alias("board"), "fetched_at", F.explode(items(F.col("j"))).alias("p"))


def _null() -> Column:
    return F.lit(None).cast("string")


def _contribution(
    source: str, *, source_id: Column, title: Column, company: Column, location: Column, url: Column,
    posted_at: Column, html: Column, plain: Column | None = None, extras: Column | None = None,
    shown_company: Column | None = None, shown_location: Column | None = None, filter_location: Column | None = None,
) -> list[Column]:
    header = raw_text_header(
        title, F.upper("board") if shown_company is None else shown_company,
        location if shown_location is None else shown_location, url,
    )
    return [
        F.lit(source).alias("source"), make_id(source, source_id).alias("id"), title.alias("title"),
        company.alias("company"), location.alias("location"),
        (location if filter_location is None else filter_location).alias("filter_location"),
        url.alias("url"), posted_at.alias("posted_at"), header.alias("header"), html.alias("html"),
        (_null() if plain is None else plain).alias("plain"), (_null() if extras is None else extras).alias("extras"),
    ]


def _base(rows: DataFrame, contribution: list[Column]) -> DataFrame:
    return rows.select("profile", "fetched_at", *contribution)


def assemble(base: DataFrame, min_comment_chars: int = vocab.MIN_COMMENT_CHARS, keep_paragraphs: bool = False) -> DataFrame:
    """Texts from what the sources contributed; the same few projections for all of them.

    The texts are built above the fields, so a later filter on title or date runs first and
    the stripping is spared for postings that do not pass.
    """
    texts, keep, rest = _texts(min_comment_chars, keep_paragraphs)
    described = base.withColumn("description", texts[0]).withColumn("title", texts[1])
    return described.where(keep).withColumns(rest).select(*NORMALIZED)


@remembered
def _texts(min_comment_chars: int, keep_paragraphs: bool = False) -> tuple[list[Column], Column, dict[str, Column]]:
    is_thread = F.col("source") == "hackernews"
    stripped = F.coalesce(filled(F.col("plain")), strip_html(F.col("html"), keep_paragraphs))
    description = F.concat_ws("\n", filled(stripped), F.col("extras"))
    title = F.coalesce("title", strip(F.substring_index("description", "\n", 1)))
    long_enough = ~is_thread | (F.length("description") >= min_comment_chars)
    full_text = F.when(is_thread, F.col("description")).otherwise(F.concat("title", F.lit(" "), "description"))
    raw_text = extract_job_context(strip(F.concat("header", "description")))
    return [description, title], long_enough, {"full_text": full_text, "raw_text": raw_text}


# What each source contributes, from a posting in the struct column ``at`` and the company in ``board``.


@remembered
def _greenhouse_fields(at: str = "p") -> list[Column]:
    return _contribution(
        "greenhouse", source_id=F.col(f"{at}.id"), title=text_of(F.col(f"{at}.title")), company=F.col("board"),
        location=F.coalesce(F.col(f"{at}.location.name"), F.lit("Unknown")), url=text_of(F.col(f"{at}.absolute_url")),
        posted_at=parse_posted_at(F.col(f"{at}.updated_at")),
        html=F.coalesce(filled(F.col(f"{at}.content")), F.col(f"{at}.description")),
    )


@remembered
def _lever_fields(at: str = "p") -> list[Column]:
    location = F.coalesce(F.col(f"{at}.categories.location"), F.lit("Unknown"))
    workplace = text_of(F.col(f"{at}.workplaceType"))
    lists = F.array_join(F.transform(f"{at}.lists", lambda x: text_of(x["content"])), " ")
    note = F.when(workplace != "", F.concat(F.lit("\nWorkplace: "), workplace)).otherwise("")
    return _contribution(
        "lever", source_id=F.col(f"{at}.id"), title=text_of(F.col(f"{at}.text")), company=F.col("board"),
        location=location, filter_location=effective_location(location, workplace),
        shown_location=F.concat(location, note), url=text_of(F.col(f"{at}.hostedUrl")),
        posted_at=parse_posted_at(F.col(f"{at}.createdAt")),
        html=F.concat(text_of(F.col(f"{at}.description")), F.lit(" "), text_of(lists)),
    )


def _thread(raw: DataFrame, as_of: Column, comments_per_thread: int | None, max_age_days: int) -> DataFrame:
    # By explode, so that a payload is parsed once and not anew in each filter that is pushed down.
    parsed = raw.where(F.col("source") == "hackernews").select(
        "profile", "fetched_at", F.explode(F.array(F.from_json("payload", THREAD))).alias("j")
    )
    hits = parsed.where("j.hits IS NOT NULL").select("profile", F.explode("j.hits").alias("h"))
    oldest = F.unix_timestamp(as_of) - max_age_days * 86_400
    threads = (
        hits.where((F.col("h.author") == vocab.THREAD_AUTHOR) & (F.col("h.created_at_i") > oldest))
        .groupBy("profile")
        .agg(F.max_by("h", F.struct("h.created_at_i", "h.objectID")).alias("h"))
        .select("profile", F.col("h.objectID").cast("bigint").alias("thread_id"), F.col("h.title").alias("thread_title"))
    )
    items = parsed.where("j.kids IS NOT NULL").select("profile", F.col("j.id").alias("thread_id"), "j.kids")
    kids = (
        threads.join(items, ["profile", "thread_id"])
        .select("profile", "thread_title", F.posexplode("kids").alias("pos", "comment_id"))
        .where(F.lit(True) if comments_per_thread is None else F.col("pos") < comments_per_thread)
        .drop("pos")
    )
    comments = parsed.where("j.text IS NOT NULL").select(
        "profile", "fetched_at", F.col("j.id").alias("comment_id"), strip(F.col("j.text")).alias("html")
    )
    return comments.join(kids, ["profile", "comment_id"]).select("profile", "fetched_at", *_comment_fields())


@remembered
def _comment_fields() -> list[Column]:
    number = F.col("comment_id").cast("string")
    header = F.concat(
        F.lit("HN Job Posting\nComment ID: "), number, F.lit("\nThread: "), text_of(F.col("thread_title")), F.lit("\n\n")
    )
    return [
        F.lit("hackernews").alias("source"), make_id("hackernews", number).alias("id"), _null().alias("title"),
        F.lit("Unknown").alias("company"), F.lit("Unknown").alias("location"), F.lit("").alias("filter_location"),
        F.concat(F.lit("https://news.ycombinator.com/item?id="), number).alias("url"),
        F.lit(None).cast("timestamp").alias("posted_at"), header.alias("header"), F.col("html"),
        _null().alias("plain"), _null().alias("extras"),
    ]


# ---- per-source fields ---------------------------------------------------------------------


def ashby_location(location: Column, location_name: Column, secondary: Column) -> Column:
    others = F.filter(F.transform(secondary, lambda s: text_of(s["location"])), lambda s: s != "")
    return F.coalesce(
        filled(location), filled(location_name), filled(F.array_join(others, " | ")), F.lit("Unknown")
    )


def ashby_description(plain: Column, html: Column) -> Column:
    return F.coalesce(filled(plain), strip_html(html))


def _place(city: Column, region: Column, country: Column) -> Column:
    return F.concat_ws(", ", filled(city), filled(region), filled(country))


def workable_location(p: Column) -> Column:
    """Remote, else the structured place, else the flat one, else the list of places."""
    place = p["location"]
    structured = _place(place["city"], F.coalesce(filled(place["region"]), place["state"]), place["country"])
    flat = _place(p["city"], p["state"], p["country"])
    listed = F.filter(
        F.transform(p["locations"], lambda x: _place(x["city"], x["region"], x["country"])), lambda s: s != ""
    )
    single = F.when(place.isNotNull(), structured).otherwise(flat)
    return F.when(F.coalesce(p["telecommuting"], F.lit(False)), F.lit("Remote")).otherwise(
        F.coalesce(filled(single), filled(F.array_join(listed, " | ")), F.lit("Unknown"))
    )


def workable_extras(p: Column) -> Column:
    """One ``Label: value`` line per extra field that is filled."""
    lines = [F.concat(F.lit(f"{label}: "), filled(p[field])) for field, label in vocab.WORKABLE_EXTRA_FIELDS]
    return filled(F.concat_ws("\n", *lines))


def workable_description(p: Column) -> Column:
    return F.concat_ws("\n", filled(strip_html(p["description"])), workable_extras(p))


def himalayas_company(company_name: Column, company: Column) -> Column:
    """``company`` is an object with a name, or plain text."""
    named = F.when(F.startswith(F.trim(company), F.lit("{")), F.get_json_object(company, "$.name")).otherwise(company)
    return F.coalesce(filled(company_name), filled(named), F.lit("Unknown"))


def himalayas_location(location: Column, restrictions: Column) -> Column:
    return F.coalesce(filled(location), filled(F.array_join(restrictions, " | ")), F.lit("Remote"))


def himalayas_url(application_link: Column, url: Column, guid: Column) -> Column:
    return F.coalesce(filled(application_link), filled(url), guid, F.lit(""))


@remembered
def _ashby_fields(at: str = "p") -> list[Column]:
    url = text_of(F.col(f"{at}.jobUrl"))
    return _contribution(
        "ashby", source_id=F.coalesce(filled(F.col(f"{at}.id")), url), title=text_of(F.col(f"{at}.title")),
        company=F.col("board"), url=url,
        location=ashby_location(F.col(f"{at}.location"), F.col(f"{at}.locationName"), F.col(f"{at}.secondaryLocations")),
        posted_at=parse_posted_at(F.coalesce(filled(F.col(f"{at}.publishedAt")), F.col(f"{at}.publishedDate"))),
        html=F.col(f"{at}.descriptionHtml"), plain=F.col(f"{at}.descriptionPlain"),
    )


@remembered
def _workable_fields(at: str = "p") -> list[Column]:
    p = F.col(at)
    location = workable_location(p)
    note = F.when(F.coalesce(p["telecommuting"], F.lit(False)), F.lit("\nWorkplace: Remote")).otherwise("")
    return _contribution(
        "workable", company=F.col("board"), title=text_of(p["title"]), location=location,
        source_id=F.coalesce(*[filled(p[c]) for c in ("id", "shortcode", "url", "shortlink")], F.lit("")),
        shown_location=F.concat(location, note),
        url=F.coalesce(*[filled(p[c]) for c in ("url", "shortlink", "application_url")], F.lit("")),
        posted_at=parse_posted_at(F.coalesce(filled(p["published_on"]), p["created_at"])),
        html=p["description"], extras=workable_extras(p),
    )


@remembered
def _himalayas_fields(at: str = "p") -> list[Column]:
    company = himalayas_company(F.col(f"{at}.companyName"), F.col(f"{at}.company"))
    url = himalayas_url(F.col(f"{at}.applicationLink"), F.col(f"{at}.url"), F.col(f"{at}.guid"))
    return _contribution(
        "himalayas", source_id=F.coalesce(F.col(f"{at}.id"), url), title=text_of(F.col(f"{at}.title")), company=company,
        shown_company=company, location=himalayas_location(F.col(f"{at}.location"), F.col(f"{at}.locationRestrictions")),
        url=url, posted_at=parse_posted_at(F.col(f"{at}.pubDate")), html=F.col(f"{at}.description"),
    )


# Per board: where its postings lie in a payload (the first place that is an array), a posting's schema, its fields.
BOARDS: dict[str, tuple[list[str], str, Callable[..., list[Column]]]] = {
    "greenhouse": (["$.jobs"], _GREENHOUSE_POSTING, _greenhouse_fields),
    "lever": (["$"], _LEVER_POSTING, _lever_fields),
    "ashby": (["$.jobs", "$.jobPostings"], _ASHBY_POSTING, _ashby_fields),
    "workable": (["$.jobs", "$.results"], _WORKABLE_POSTING, _workable_fields),
    "himalayas": (["$.jobs"], _HIMALAYAS_POSTING, _himalayas_fields),
}


@remembered
def _board_columns() -> tuple[Column, list[Column], Column, list[Column]]:
    """A payload's postings, a posting by board, whether it is listed, and what it contributes."""
    source = F.col("source")

    def by_board(values: dict[str, Column]) -> Column:
        first, *rest = values.items()
        out = F.when(source == first[0], first[1])
        for board, value in rest:
            out = out.when(source == board, value)
        return out

    places = {b: F.coalesce(*[F.try_variant_get("doc", at, "array<variant>") for at in ways]) for b, (ways, _, _) in BOARDS.items()}
    postings = [F.when(source == b, F.try_variant_get("posting", "$", schema)).alias(f"p_{b}") for b, (_, schema, _) in BOARDS.items()]
    fields = {b: build(f"p_{b}") for b, (_, _, build) in BOARDS.items()}
    names = ["source", "id", "title", "company", "location", "filter_location", "url", "posted_at", "header", "html", "plain", "extras"]
    merged = [by_board({b: own[i] for b, own in fields.items()}).alias(name) for i, name in enumerate(names)]
    return by_board(places), postings, (source != "ashby") | _listed("p_ashby"), merged


def _boards(raw: DataFrame) -> DataFrame:
    """The postings of all boards in one pass over the landed rows: one parse, one explode, one choice per field."""
    items, postings, listed, fields = _board_columns()
    rows = raw.where(F.col("source").isin(*BOARDS)).select("profile", "source", F.col("company").alias("board"), "fetched_at", F.try_parse_json("payload").alias("doc"))
    each = rows.select("profile", "source", "board", "fetched_at", F.explode(items).alias("posting"))
    return each.select("profile", "source", "board", "fetched_at", *postings).where(listed).select("profile", "fetched_at", *fields)


def _listed(at: str = "p") -> Column:
    return F.coalesce(F.col(f"{at}.isListed"), F.lit(True))


def normalize_greenhouse(raw: DataFrame) -> DataFrame:
    return assemble(_base(exploded(raw, "greenhouse", GREENHOUSE, lambda j: j["jobs"]), _greenhouse_fields()))


def normalize_lever(raw: DataFrame) -> DataFrame:
    return assemble(_base(exploded(raw, "lever", LEVER, lambda j: j), _lever_fields()))


def normalize_ashby(raw: DataFrame) -> DataFrame:
    rows = exploded(raw, "ashby", ASHBY, lambda j: F.coalesce(j["jobs"], j["jobPostings"]))
    return assemble(_base(rows.where(_listed()), _ashby_fields()))


def normalize_workable(raw: DataFrame) -> DataFrame:
    rows = exploded(raw, "workable", WORKABLE, lambda j: F.coalesce(j["jobs"], j["results"]))
    return assemble(_base(rows, _workable_fields()))


def normalize_himalayas(raw: DataFrame) -> DataFrame:
    return assemble(_base(exploded(raw, "himalayas", HIMALAYAS, lambda j: j["jobs"]), _himalayas_fields()))


def normalize_thread(
    raw: DataFrame, as_of: Column, comments_per_thread: int | None = None,
    max_age_days: int = vocab.THREAD_MAX_AGE_DAYS, min_comment_chars: int = vocab.MIN_COMMENT_CHARS,
) -> DataFrame:
    """Comments of the newest hiring thread, without the very short ones.

    Raw rows of this source hold a search result (``hits``), a thread (``id``, ``kids``) or a
    comment (``id``, ``text``). ``comments_per_thread`` takes only the first so many, as a polite
    client of the live service would; landed comments are all taken.
    """
    return assemble(_thread(raw, as_of, comments_per_thread, max_age_days), min_comment_chars)


def union_postings(parts: list[DataFrame]) -> DataFrame:
    """Sources with one schema under each other; columns match by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def normalize_all(
    raw: DataFrame, as_of: Column, comments_per_thread: int | None = None,
    max_age_days: int = vocab.THREAD_MAX_AGE_DAYS, min_comment_chars: int = vocab.MIN_COMMENT_CHARS,
    keep_paragraphs: bool = False,
) -> DataFrame:
    """All sources: the boards in one pass, the thread source beside them, then the texts once for all rows.

    With ``keep_paragraphs`` the blocks of HTML bodies stay paragraphs, so that they can be told apart as sections.
    """
    return assemble(union_postings([_boards(raw), _thread(raw, as_of, comments_per_thread, max_age_days)]), min_comment_chars, keep_paragraphs)
