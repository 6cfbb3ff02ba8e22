"""Keys, canonical names, codes and small projections as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostra.functions.text import fold

#: Groups of result codes; others stand for themselves. Fixed values.
RESULT_GROUPS = {
    "approved": ("approve", "adopt", "confirm", "approved", "approved_acclamation", "beslut"),
    "rejected": ("reject", "reject_counterproposal", "rejected", "avslag"),
    "recorded": ("acknowledge", "file", "noted", "noterad"),
    "continued": ("postpone", "return", "refer", "tabled", "remitted_back", "forwarded", "aterremiss", "återremiss", "bordlaggning", "bordläggning", "overlamnad", "överlämnad"),
    "answered": ("consider_answered", "considered_answered", "besvarad"),
    "other": ("assign", "appoint", "revoke", "other", "arende", "ärende"),
}
#: Months by their Swedish names. Fixed values.
MONTHS = ("januari", "februari", "mars", "april", "maj", "juni", "juli", "augusti", "september", "oktober", "november", "december")
#: Words in matters' titles, in order of precedence, and the type each stands for. Fixed values.
MATTER_WORDS = (
    ("interpellation", "interpellation"), ("motion", "motion"), ("ledamotsinitiativ", "member_initiative"), ("medborgarförslag", "member_initiative"),
    ("val av", "appointment"), ("protokollsjusterare", "appointment"), ("delegationsordning", "delegation_matter"), ("delegationsbeslut", "delegation_matter"),
    ("budget", "budget_matter"), ("ekonomisk", "financial_report"), ("delårsrapport", "financial_report"), ("årsredovisning", "financial_report"),
    ("remiss", "referral_response"), ("detaljplan", "planning_matter"), ("planprogram", "planning_matter"), ("taxa", "fee_or_tax_matter"),
    ("avgift", "fee_or_tax_matter"), ("riktlinje", "document_matter"), ("policy", "document_matter"), ("information", "information_matter"),
    ("anmälan", "administrative_matter"), ("godkännande av dagordning", "administrative_matter"), ("jäv", "administrative_matter"), ("övriga frågor", "question"),
)
#: Phrases of decisions, in order of precedence: result, outcome. Fixed values.
RESULT_PHRASES = (
    (("avslås", "avslår"), "reject", "rejected"), (("bifalls", "bifaller"), "approve", "approved"), (("återrem",), "refer_back", "referred_back"),
    (("bordlägg",), "postpone", "postponed"), (("utgår",), "withdraw", "withdrawn"),
    (("läggs till handlingarna", "tas till protokollet", "informationen tas"), "acknowledge", "information_only"),
)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def squeezed(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def composite_key(*cols: Column) -> Column:
    """Parts joined by ``|``; a null part is empty, so keys never lose a place."""
    return F.concat_ws("|", *[text_or_empty(c) for c in cols])


def body_name(col: Column) -> Column:
    """Single blanks, no trailing range of years, no doubled s in a frequent misspelling."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(col), r"\s+", " "), " 20[0-9]{2}.*20[0-9]{2}$", "")
    return F.trim(F.regexp_replace(plain, "hållbarhetssutskott", "hållbarhetsutskott"))


def region_name(col: Column, aliases: dict[str, str] | None = None) -> Column:
    bare = F.regexp_replace(F.trim(text_or_empty(col)), r"\s+[lL][äÄ][nN]$", "")
    return mapped(bare, aliases or {})


def mapped(col: Column, table: dict[str, str]) -> Column:
    """Labels of codes; unknown codes pass through."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col), col) if table else col


def party_name(col: Column, aliases: dict[str, Sequence[str]]) -> Column:
    """The canonical party whose folded alias the name is, or the name itself."""
    key = F.regexp_replace(fold(text_or_empty(col)), "[^a-z0-9]", "")
    out = F.trim(text_or_empty(col))
    for name, folded in aliases.items():
        out = F.when(key.isin(*folded), F.lit(name)).otherwise(out)
    return out


def result_group(code: Column) -> Column:
    c = F.when(F.coalesce(code, F.lit("")) == "", "beslut").otherwise(F.lower(F.trim(code)))
    out = c
    for group, codes in RESULT_GROUPS.items():
        out = F.when(c.isin(*codes), group).otherwise(out)
    return out


#: Phrases by which a text rejects, between word edges and over any white space. Fixed values.
REJECTIONS = (
    r"\b(ledamotsinitiativet|initiativet|motionen|medborgarförslaget|medborgarforslaget)\s+avslås\b"
    r"|\bavslår\s+yrkandet\s+om\b"
)


def effective_result(result: Column, *texts: Column) -> Column:
    """The stated result, unless it or the text says that something was rejected. Phrases are case-sensitive."""
    r, text = text_or_empty(result), F.concat_ws(" ", *[F.when(t != "", t) for t in texts])
    return (
        F.when(r == "reject_counterproposal", r)
        .when(r.isin("reject", "rejected", "avslag"), "reject")
        .when(text.rlike(REJECTIONS), "reject")
        .when(r != "", r)
        .otherwise("other")
    )


def is_noise_title(col: Column) -> Column:
    return (col == "") | col.rlike("^§ *[0-9]+$") | ((F.length(col) > 150) & F.lower(col).rlike("ledamöter|ersättare|närvarande"))


def first_title(*cols: Column) -> Column:
    """The first that is no noise."""
    return F.coalesce(*[F.when(~is_noise_title(text_or_empty(c)), c) for c in cols], F.lit(""))


def section_number(col: Column) -> Column:
    return F.nullif(F.regexp_extract(text_or_empty(col), r"([0-9]{1,4}(\.[0-9]+)?)", 1), F.lit(""))


def title_from_header(header: Column, title: Column) -> Column:
    """What follows the section mark and number in a header, else the title as it is."""
    found = squeezed(F.regexp_extract(text_or_empty(header), r"^§ *[0-9]+(?:\.[0-9]+)?(.*)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), title)


def valid_diary(col: Column) -> Column:
    """The number, unless it has no digit or is a placeholder."""
    c = F.trim(text_or_empty(col))
    return F.when(c.rlike("[0-9]") & ~F.lower(c).rlike("x"), c)


def first_valid(*cols: Column) -> Column:
    return F.coalesce(*[valid_diary(c) for c in cols], F.lit(""))


def stable_hash(*cols: Column) -> Column:
    """16 hex digits over the values in lower case with single blanks."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.lower(squeezed(text_or_empty(c))) for c in cols]), 256), 1, 16)


def slug(col: Column, mark: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text_or_empty(col)), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def pdf_anchor(url: Column, page: Column, search: Column) -> Column:
    """The url with page, zoom and search fragment; blanks become %20."""
    words = F.replace(F.url_encode(text_or_empty(search)), F.lit("+"), F.lit("%20"))
    parts = F.concat_ws("&", F.when(page > 0, F.concat(F.lit("page="), page.cast("string"))), F.lit("zoom=100"), F.when(words != "", F.concat(F.lit("search="), words)))
    return F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#"), parts)


def preview(col: Column, n: int) -> Column:
    return F.when(F.length(col) > n, F.concat(F.rtrim(F.substring(col, 1, n)), F.lit("…"))).otherwise(col)


def month_shifted(date: Column, n: int) -> Column:
    return F.date_format(F.add_months(date, n), "yyyy-MM")


def display_date(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def swedish_date(col: Column, year: Column) -> Column:
    """ISO form of ``3 mars 2024``; a date without year gets the one given."""
    pattern = "([0-9]{1,2}) +(" + "|".join(MONTHS) + ")( +(20[0-9]{2}))?"
    low = F.lower(col)
    day, month, own = (F.regexp_extract(low, pattern, i) for i in (1, 2, 4))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month)
    return F.when(day != "", F.concat_ws("-", F.coalesce(F.nullif(own, F.lit("")), year.cast("string")), F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")))


def percent_text(part: Column, whole: Column) -> Column:
    """A count's share of another, in hundredths of a percent, halves up; decided by integers, so no rounding of quotients shows."""
    part, whole = part.cast("bigint"), whole.cast("bigint")
    hundredths = F.call_function("div", part * 20000 + whole, 2 * whole)
    return F.when(whole != 0, F.format_string("%d.%02d%%", F.call_function("div", hundredths, F.lit(100)), hundredths % 100)).otherwise("0.00%")


def matter_type(*texts: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *[text_or_empty(t) for t in texts]))
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(k)) for w, k in MATTER_WORDS], F.lit("unclassified"))


def result_class(decision: Column) -> Column:
    """(result, outcome, confidence) by the first phrase found."""
    text, none = F.lower(text_or_empty(decision)), ("other", "other", "high")
    make = lambda r, o, c: F.struct(F.lit(r).alias("result"), F.lit(o).alias("outcome"), F.lit(c).alias("confidence"))
    out = F.when(text == "", make("decision_not_extracted", "not_extracted", "low"))
    for phrases, result, outcome in RESULT_PHRASES:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(text, F.lit(p))
        out = out.when(hit, make(result, outcome, "high"))
    return out.otherwise(make(*none))


def body_type(body: Column, known: dict[str, str]) -> Column:
    key = F.lower(body)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key), F.when(key.startswith("kommunstyrelsens "), "kommunstyrelseutskott"), F.lit("namnd"))


def proposal_type(point_type: Column, document_type: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text_or_empty(point_type)), F.lit("")), F.nullif(F.trim(text_or_empty(document_type)), F.lit("")), F.lit("beslut"))


#: Numbers that one range may span.
MOST_SPAN = 1000
#: A number: a run of up to ten digits as a whole; longer runs are none, and are read in fours.
RANGE_NUMBER = "(?:(?<![0-9])[0-9]{1,10}(?![0-9])|[0-9]{1,4})"


def expanded_ranges(col: Column) -> Column:
    """``1–3, 5 och 7-8`` as sorted distinct integers. Ranges that run backwards or span more than MOST_SPAN are left out."""
    parts = F.regexp_extract_all(text_or_empty(col), F.lit(f"({RANGE_NUMBER}(?:\\s*[–-]\\s*{RANGE_NUMBER})?)"), F.lit(1))
    ends = F.transform(parts, lambda x: F.transform(F.split(x, "\\s*[–-]\\s*"), lambda y: y.cast("bigint")))
    pairs = F.transform(ends, lambda e: F.struct(F.get(e, F.lit(0)).alias("a"), F.element_at(e, -1).alias("b")))
    sound = F.filter(pairs, lambda p: (p["a"] <= p["b"]) & (p["b"] - p["a"] <= MOST_SPAN))
    return F.sort_array(F.array_distinct(F.flatten(F.transform(sound, lambda p: F.sequence(p["a"], p["b"])))))


def ignorable_line(col: Column) -> Column:
    """Boilerplate and page footers ``n (m)``."""
    clean = F.lower(squeezed(text_or_empty(col)))
    return (clean == "") | clean.rlike(r"^([a-zåäö]+ )?protokoll( digitalt justerat)?$") | clean.isin("digitalt justerat", "digitalt justerat protokoll") | clean.rlike(r"^[0-9]+ ?\([0-9]+\)$")


def looks_truncated(col: Column) -> Column:
    """Text that ends inside a word or sentence."""
    return F.rtrim(text_or_empty(col)).rlike("([,;:(-]| (och|att|som|för|av|the|of|and|de|la))$")


def clean_field(col: Column) -> Column:
    """Soft hyphens, hyphenated line ends and page footers taken out of extracted text."""
    joined = F.regexp_replace(F.regexp_replace(text_or_empty(col), "­", ""), "([a-zåäö])-\n([a-zåäö])", "$1$2")
    return squeezed(F.regexp_replace(joined, r"(?m)^ *[0-9]+ ?\([0-9]+\) *$", ""))
