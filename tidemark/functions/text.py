"""Text expressions: identity hash, tokens, sentences, quotes, identifiers. Columns in, columns out; no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNICODE_BLANKS = r"   -   　"
_EDGE = rf"[\s\x0b\x1c-\x1f\u0085  {_UNICODE_BLANKS}]+"


#: White space other than single blanks and line feeds, told by what all other characters are: that is one quick look.
_UNUSUAL = r"[^ -~\n\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]"


def unusual(text: Column) -> Column:
    """Whether a text may have white space other than blanks and line feeds."""
    return text.rlike(_UNUSUAL)


def normalised(text: Column) -> Column:
    """Line ends, runs of blanks, trailing blanks, blank lines and outer white space made uniform."""
    loose = text.contains("  ") | text.contains(" \n") | text.contains("\n\n\n")
    plain = F.regexp_replace(F.replace(F.regexp_replace(text, "  +", " "), F.lit(" \n"), F.lit("\n")), r"\n\n\n+", "\n\n")
    # most texts have none of what the patterns look for, and are looked through for it once
    return F.when(unusual(text), _normalised(text)).otherwise(F.trim(F.when(loose, plain).otherwise(text), F.lit(" \n")))


def _normalised(text: Column) -> Column:
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"[\x0b\x0c\x1c-\x1e\u0085  ]", "\n")
    text = F.regexp_replace(text, rf"[ \t\x1f{_UNICODE_BLANKS}]+(?=\n|\z)", "")
    text = F.regexp_replace(text, r"\n\n+", "\n\n")
    return F.regexp_replace(text, rf"\A{_EDGE}|{_EDGE}\z", "")


def stripped(text: Column) -> Column:
    """Without white space at its ends, line feeds too (trim() takes blanks alone)."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def content_hash(text: Column) -> Column:
    """The identity of a chunk or document: SHA-256 of its normalised text. Headers are never part of it."""
    return F.sha2(normalised(text), 256)


def is_content_hash(text: Column) -> Column:
    return text.rlike(r"\A[a-f0-9]{64}\z")


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\n+")


def lines(text: Column) -> Column:
    """Lines with something in them, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_hashes(text: Column) -> Column:
    """The content hashes of the lines() of a text, in order. What is usual in the text is so in its lines: of those only
    runs of blanks are left to be made uniform."""
    plain = F.transform(lines(text), lambda x: F.sha2(F.when(x.contains("  "), F.regexp_replace(x, "  +", " ")).otherwise(x), 256))
    return F.when(unusual(text), F.transform(lines(text), content_hash)).otherwise(plain)


def without_quotes(text: Column) -> Column:
    """A message's own words: lines that quote ('>') and lines that introduce a quote go."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).startswith(">") & ~F.trim(x).rlike(r"^On .+ wrote:$"))
    return stripped(F.array_join(kept, "\n"))


def normalised_email(text: Column) -> Column:
    return F.lower(F.trim(text))


def address_in(text: Column) -> Column:
    """The address of 'Name <address>' or 'mailto:address', else the text."""
    inner = F.regexp_extract(text, r"<([^<>]+@[^<>]+)>", 1)
    return normalised_email(F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"(?i)^\s*mailto:", ""))


#: Fixed values of the numbering plan. Country codes of one and of two digits; all others have three. Of countries with
#: lengths of their own: the least and most digits behind the code, and the trunk prefix that goes there.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
LENGTHS = {
    "1": (10, 10, "1"), "7": (10, 10, "8"), "20": (8, 10, "0"), "27": (9, 9, "0"), "30": (10, 10, ""), "31": (9, 9, "0"), "32": (8, 9, "0"), "33": (9, 9, "0"), "34": (9, 9, ""), "36": (8, 9, "06"), "39": (6, 11, ""),
    "40": (9, 9, "0"), "41": (9, 9, "0"), "43": (4, 13, "0"), "44": (9, 10, "0"), "45": (8, 8, ""), "46": (7, 10, "0"), "47": (8, 8, ""), "48": (9, 9, ""), "49": (5, 13, "0"), "51": (8, 9, "0"), "52": (10, 10, ""), "55": (10, 11, "0"),
    "56": (9, 9, ""), "57": (8, 10, "0"), "58": (10, 10, "0"), "60": (8, 10, "0"), "61": (9, 9, "0"), "62": (7, 12, "0"), "63": (8, 10, "0"), "64": (8, 10, "0"), "65": (8, 8, ""), "66": (8, 9, "0"), "81": (9, 10, "0"), "82": (8, 10, "0"),
    "84": (9, 10, "0"), "86": (10, 11, "0"), "90": (10, 10, "0"), "91": (10, 10, "0"), "92": (9, 10, "0"), "98": (10, 10, "0"), "351": (9, 9, ""), "353": (7, 9, "0"), "358": (5, 12, "0"), "972": (8, 9, "0"),
}


def country_code(digits: Column) -> Column:
    """The code that digits behind a plus begin with."""
    return F.when(F.substring(digits, 1, 1).isin(*ONE_DIGIT), F.substring(digits, 1, 1)).when(F.substring(digits, 1, 2).isin(*TWO_DIGITS), F.substring(digits, 1, 2)).otherwise(F.substring(digits, 1, 3))


def international(digits: Column) -> Column:
    """E.164 of digits that begin with a country code: a trunk prefix behind the code goes, if the number is as long as
    its country has them then; else ''. Countries without lengths of their own have 4 to 15 digits, code included."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(*[F.lit(v).alias(n) for n, v in zip(("least", "most", "trunk"), x, strict=True)]) for pair in LENGTHS.items() for x in pair])

    def judged(parts: Column) -> Column:
        code, rest = parts["code"], parts["rest"]
        plan = F.coalesce(F.try_element_at(table, code), F.struct(F.lit(4).alias("least"), (F.lit(15) - F.length(code)).alias("most"), F.lit("0").alias("trunk")))
        bare = F.when((plan["trunk"] != "") & F.startswith(rest, plan["trunk"]), F.substr(rest, F.length(plan["trunk"]) + 1)).otherwise(rest)
        fits = lambda x: F.length(x).between(plan["least"], plan["most"])
        return F.when(fits(bare), F.concat(F.lit("+"), code, bare)).when(fits(rest), F.concat(F.lit("+"), code, rest)).otherwise("")

    parts = F.struct(country_code(digits).alias("code"), F.substr(digits, F.length(country_code(digits)) + 1).alias("rest"))
    return F.transform(F.array(parts), judged)[0]


def normalised_phone(text: Column) -> Column:
    """E.164 for numbers of the North American plan, and for those with a country code after + or after the plan's
    international prefix 011, by their country's lengths and trunk prefix; else ''. An extension is dropped."""
    bare = F.regexp_replace(F.lower(text), r"\s*(?:x|ext\.?|extension|#)\s*\d+\s*$", "")
    bare = F.regexp_replace(bare, r"^\D*0\D*1\D*1(?=(?:\D*[1-9])(?:\D*\d){6,14}\D*$)", "+")
    digits = F.regexp_replace(bare, r"\D", "")
    plus = F.ltrim(bare).startswith("+")
    return (
        F.when(plus & digits.rlike("^[1-9]"), international(digits))
        .when(~plus & (F.length(digits) == 10) & digits.rlike("^[2-9]"), F.concat(F.lit("+1"), digits))
        .when(~plus & (F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
        .otherwise("")
    )


def normalised_identifier(text: Column) -> Column:
    return F.when(text.contains("@"), normalised_email(text)).otherwise(normalised_phone(text))


def distinct_emails(emails: Column) -> Column:
    return F.array_distinct(F.transform(emails, normalised_email))


def distinct_phones(phones: Column) -> Column:
    """E.164 where it parses, else as given; first places keep."""
    def one(x: Column) -> Column:
        return F.when(normalised_phone(x) != "", normalised_phone(x)).otherwise(x)

    return F.array_distinct(F.transform(phones, one))


def links_in(markdown: Column) -> Column:
    """Targets of markdown links and bare web addresses, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(markdown, F.lit(r"(https?://[^\s)\]>\"']+)"), 1))


def titled_links(markdown: Column) -> Column:
    """(title, url) of markdown links, in order: the text shown, or what stands in quotes behind the target."""
    pattern = F.lit(r"""(?<!!)\[([^\]\[]*)\]\(\s*<?([^\s()<>]+)>?(?:\s+"([^"]*)")?\s*\)""")
    parts = [F.regexp_extract_all(markdown, pattern, i) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("shown", "url", "quoted"), strict=True)]), lambda x: F.struct(or_else(x["quoted"], x["shown"]).alias("title"), x["url"].alias("url")))


def wikilinks(markdown: Column) -> Column:
    """Targets of [[target]], [[target|shown]] and [[target#heading]]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(markdown, F.lit(r"\[\[([^\]\[|#]+)"), 1), lambda x: F.trim(x)))


def has_headings(markdown: Column) -> Column:
    return markdown.rlike(r"(?m)^#{1,6}\s")


def has_lists(markdown: Column) -> Column:
    return markdown.rlike(r"(?m)^\s*(?:[-*+]|\d+\.)\s")


def has_tables(markdown: Column) -> Column:
    return markdown.rlike(r"(?m)^\s*\|.*\|\s*$")


def extension(path: Column) -> Column:
    """All after the last dot of the file's name."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


#: Categories of file extensions.
CATEGORIES = {
    "pdf": ["pdf"],
    "text": ["md", "txt", "rst", "org", "rtf", "doc", "docx"],
    "code": ["js", "ts", "tsx", "jsx", "py", "go", "rs", "java", "c", "cpp", "h", "sh", "yaml", "yml", "json", "toml", "css", "html", "xml", "sql"],
    "image": ["png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "ico"],
    "archive": ["zip", "tar", "gz", "bz2", "rar", "7z"],
    "spreadsheet": ["csv", "xlsx", "xls", "ods", "tsv"],
    "video": ["mp4", "mov", "avi", "mkv", "webm"],
    "audio": ["mp3", "wav", "flac", "aac", "m4a", "ogg"],
}


def file_category(path: Column) -> Column:
    out = F.lit("other")
    for name, extensions in CATEGORIES.items():
        out = F.when(extension(path).isin(extensions), name).otherwise(out)
    return out


#: Names of document types.
TYPE_NAMES = {"text/markdown": "Markdown", "text/plain": "Text", "application/pdf": "PDF", "audio/mpeg": "Music", "audio/mp4": "Music"}


def document_type(adapter_id: Column) -> Column:
    """The type of a source's documents, as its adapter tells it."""
    return F.when(F.contains(adapter_id, F.lit("music")), "audio/mpeg").otherwise("text/markdown")


def document_type_name(kind: Column) -> Column:
    """Its name in lists; a type without one is its own."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair]), kind), kind)


def preview(text: Column, length: int = 300) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def highlight_terms(query: Column) -> Column:
    """Terms of a search that are marked in results: those longer than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda x: F.length(x) > 2))


def iso_timestamp(text: Column) -> Column:
    """Whether text is an ISO 8601 date, or date and time with an optional fraction and zone."""
    return text.rlike(r"\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\z")


def iso_from_spaced(text: Column) -> Column:
    """'2026-01-15 09:30:00 -0500' as '2026-01-15T09:30:00-05:00'; other texts as they are."""
    return F.regexp_replace(text, r"\A(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{2})(\d{2})\z", "$1T$2$3:$4")


def or_else(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


#: Words and phrases by which a chunk refers to its neighbours, in lower case. A direction word alone
#: refers to nothing; it takes a positional or an explicit phrase as well.
ABOVE = r"\b(?:above|earlier|previous|preceding)\b"
BELOW = r"\b(?:below|following|next|later)\b"
POSITIONAL = (
    r"(?:as\s+)?(?:shown|defined|described)\s+(?:in\s+)?(?:the\s+)?(?:above|previous|preceding|below|following|next|later)",
    r"(?:table|figure|code|section|chapter)\s+(?:above|below|earlier|later|previously|following|next|previous)",
)
EXPLICIT = (
    r"as\s+(?:shown|defined|explained|described)\s+in\s+(?:the\s+)?(?:table|figure|section|chapter|code|example)",
    r"(?:see|refer\s+to)\s+(?:the\s+)?(?:table|figure|section|chapter|code|example)",
    r"(?:following|next|above|previous)\s+(?:table|figure|section|chapter|code|block|example)",
    r"(?:table|figure|section|chapter)\s+(?:below|above)",
)


def refers(content: Column) -> tuple[Column, Column]:
    """(refers to chunks before, refers to chunks after): an explicit phrase without a direction refers to both."""
    lower = F.lower(content)
    above, below = lower.rlike(ABOVE), lower.rlike(BELOW)
    positional, explicit = lower.rlike("|".join(POSITIONAL)), lower.rlike("|".join(EXPLICIT))
    return (positional | explicit) & above | explicit & ~above & ~below, (positional | explicit) & below | explicit & ~above & ~below
