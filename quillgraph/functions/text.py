"""Column expressions over text: normalising, ids, estimates, dates, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a summary section, and month names.
SUMMARY_WORDS = (
    "purpose",
    "summary",
    "executive summary",
    "introduction",
    "overview",
    "scope",
    "background",
    "abstract",
    "objectives",
    "recitals",
    "whereas",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS_DE = ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember")
#: Scripts without blanks between words, as ranges for a character class.
CJK = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af"


def collapse(c: Column) -> Column:
    """White-space runs become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, " ", " "), r"\s+", " "))


def canonical_key(c: Column) -> Column:
    """Lower-cased name in which signs other than letters, digits, _ and & are blanks. Null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w&\s]", " "), r"(?U)\s+", " "))


def stable_id(prefix: str, *parts: Column, digits: int = 12) -> Column:
    """prefix, then hex digits of the SHA-256 of the parts, one a line."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, digits))


def section_id(doc: Column, path: Column) -> Column:
    return F.concat(F.lit("sec_"), F.substring(F.md5(F.concat_ws(":", doc, path)), 1, 16))


def tokens_by_length(c: Column) -> Column:
    """About four characters a token."""
    return F.floor(F.length(c) / 4).cast("long")


def tokens_cjk(c: Column) -> Column:
    """1.5 tokens a CJK character, a quarter for others that are no white space; at least 1."""
    cjk = F.length(F.regexp_replace(c, f"[^{CJK}]", ""))
    rest = F.length(F.regexp_replace(c, f"[{CJK}\\s]", ""))
    return F.greatest(F.floor(cjk * 1.5).cast("long") + F.floor(rest / 4).cast("long"), F.lit(1).cast("long"))


def cjk_share(c: Column) -> Column:
    solid = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(solid == 0, 0.0).otherwise(F.length(F.regexp_replace(c, f"[^{CJK}]", "")) / solid)


def non_latin_share(c: Column) -> Column:
    """Share of letters outside ASCII."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(c, r"[^\p{L}]|[A-Za-z]", "")) / letters)


def strip_markers(c: Column) -> Column:
    """Drops the marks of sentences, such as [12a]; those of blocks, such as [1], stay."""
    return F.trim(F.regexp_replace(c, r"\s*\[\d+[a-z]\]", ""))


def fulltext_terms(c: Column) -> Column:
    """Letters, digits and blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9\s]", " "), r"\s+", " "))


def escape_query(c: Column) -> Column:
    """A backslash before each sign that full-text query languages read."""
    return F.regexp_replace(c, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")


def leaf_title(path: Column) -> Column:
    return F.element_at(F.split(path, " > "), -1)


def path_prefixes(path: Column) -> Column:
    """Every ancestor path and the path itself, from the root down."""
    parts = F.split(path, " > ")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), " > "))


def is_summary_title(title: Column) -> Column:
    out = F.lit(False)
    for w in SUMMARY_WORDS:
        out = out | F.contains(F.lower(title), F.lit(w))
    return out


def pascal_case(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "[_\\-\\s]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def document_date(c: Column) -> Column:
    """The latest valid date (1900 to 2100) that a text names as M/D/Y, Y-M-D, Month D, Y, D. Month Y or D.M.Y; null if none."""
    names = sorted(set(MONTHS + MONTHS_DE), key=lambda m: (-len(m), m))  # a name before its own beginning
    month = "(?i)(" + "|".join(names) + ")"
    numbers = F.create_map(*[F.lit(x) for name in names for x in (name, str(MONTHS.index(name) + 1 if name in MONTHS else MONTHS_DE.index(name) + 1))])

    def found(pattern: str, y: int, m: int, d: int, named: bool = False) -> Column:
        def one(piece: Column) -> Column:
            year, day = F.regexp_extract(piece, pattern, y), F.regexp_extract(piece, pattern, d)
            mon = F.lower(F.regexp_extract(piece, pattern, m))
            if named:
                mon = numbers[mon]
            return F.try_to_date(F.concat_ws("-", year, F.lpad(mon, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), one)

    dates = F.concat(
        found(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 3, 1, 2),
        found(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", 1, 2, 3),
        found(month + r"\s+(\d{1,2}),?\s+(\d{4})", 3, 1, 2, True),
        found(r"(\d{1,2})\.?\s+" + month.replace("(?i)", "(?i:").replace("(?i:(", "(?i)(") + r"\s+(\d{4})", 3, 2, 1, True),
        found(r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", 3, 2, 1),
    )
    return F.array_max(F.filter(dates, lambda d: (F.year(d) >= 1900) & (F.year(d) <= 2100)))


def safe_folder(c: Column) -> Column:
    """A folder name without path parts: separators and dots at the ends are dropped, other odd signs become _."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[/\\\\]+", " "), r"^[. ]+|[. ]+$", ""), r"[^A-Za-z0-9 ._-]", "_")


def row_sentence(headers: list[str], *cells: Column) -> Column:
    """A table row as `Header: value` parts; empty cells are left out."""
    return F.concat_ws(", ", *[F.when(c.cast("string") != "", F.concat(F.lit(h + ": "), c.cast("string"))) for h, c in zip(headers, cells, strict=True)])


def key_values(c: Column) -> Column:
    """(key, value) of each line that reads `Key: value`."""
    line = r"(?m)^([A-Z][A-Za-z ]{1,30}): *(\S[^\n]*)$"
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(line), F.lit(1)).alias("key"), F.regexp_extract_all(c, F.lit(line), F.lit(2)).alias("value"))


# Prefixes of locales that are written from the right, and what ends a sentence.
RTL_PREFIXES = ("ar", "he", "fa", "ur", "yi")
CJK_PREFIXES = ("zh", "ja", "ko")
CJK_DELIMITERS = ("。", "！", "？", "．", "!", "?", ".")
DELIMITERS = (".", "!", "?")


def has_prefix(locale: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a locale such as `ar-EG` begins with one of the language codes; null is false."""
    return F.coalesce(F.lower(F.substring_index(F.replace(locale, F.lit("_"), F.lit("-")), "-", 1)).isin(*prefixes), F.lit(False))


def is_rtl(locale: Column) -> Column:
    return has_prefix(locale, RTL_PREFIXES)


def sentence_delimiters(locale: Column) -> Column:
    return F.when(has_prefix(locale, CJK_PREFIXES), F.array(*map(F.lit, CJK_DELIMITERS))).otherwise(F.array(*map(F.lit, DELIMITERS)))


def strip_tags(c: Column, tags: tuple[str, ...] = ("skeleton", "context", "source")) -> Column:
    """Drops opening and closing marks such as <skeleton id=3>; what they hold stays."""
    return F.trim(F.regexp_replace(c, rf"(?i)</?(?:{'|'.join(tags)})\b[^>]*>", ""))


def keyword_pattern(keyword: Column) -> Column:
    """A pattern that finds a keyword whatever white space parts its words."""
    escaped = F.regexp_replace(F.trim(F.lower(keyword)), r"([.+*?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("(?i)"), F.regexp_replace(escaped, r"\s+", r"\\s+"))


def community_summary(c: Column) -> Column:
    """(title, summary) of a text with `TITLE:` and `SUMMARY:` lines; without a title the first line, cut to 80 signs, is one; without a summary the whole text."""
    title, summary = F.trim(F.regexp_extract(c, r"(?im)^\s*TITLE:\s*(.+)$", 1)), F.trim(F.regexp_extract(c, r"(?is)SUMMARY:\s*(.+)", 1))
    first = F.substring(F.trim(F.substring_index(F.trim(c), "\n", 1)), 1, 80)
    return F.struct(F.when(title != "", title).otherwise(first).alias("title"), F.when(summary != "", summary).otherwise(F.trim(c)).alias("summary"))


def seed_phrase(c: Column) -> Column:
    """Lower case, everything but letters and digits a single blank; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def header_text(field: Column) -> Column:
    """`due_date` as `Due Date`."""
    return F.initcap(F.replace(field, F.lit("_"), F.lit(" ")))


def edge_id(src: Column, dst: Column, own: Column) -> Column:
    """An edge's own id, else `src->dst`."""
    return F.coalesce(F.nullif(own, F.lit("")), F.concat(src, F.lit("->"), dst))


def document_key(*candidates: Column) -> Column:
    """The first candidate that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates])
