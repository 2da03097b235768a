"""Text functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CJK ranges of the reference's rules
CJK = r"一-鿿"
CJK_COMMON = r"一-龥"
# Characters that stand next to CJK without a space
BESIDE_CJK = r"a-zA-Z0-9\(\)\[\]@#$%!&\*\-=+_"
# Names of the characters that a relationship name may not hold
RELATION_NAMES = [
    ("...", "_ellipsis_"), ("…", "_ellipsis_"), ("。", "_period_"), ("，", "_comma_"), ("；", "_semicolon_"), ("：", "_colon_"),
    ("！", "_exclamation_"), ("？", "_question_"), ("（", "_lparen_"), ("）", "_rparen_"), ("【", "_lbracket_"), ("】", "_rbracket_"),
    ("《", "_langle_"), ("》", "_rangle_"), ("'", "_apostrophe_"), ('"', "_quote_"), ("\\", "_backslash_"), ("/", "_slash_"),
    ("|", "_pipe_"), ("&", "_ampersand_"), ("=", "_equals_"), ("+", "_plus_"), ("*", "_asterisk_"), ("^", "_caret_"),
    ("%", "_percent_"), ("$", "_dollar_"), ("#", "_hash_"), ("@", "_at_"), ("!", "_bang_"), ("?", "_question_"),
    ("(", "_lparen_"), (")", "_rparen_"), ("[", "_lbracket_"), ("]", "_rbracket_"), ("{", "_lbrace_"), ("}", "_rbrace_"),
    ("<", "_langle_"), (">", "_rangle_"),
]


def words(text: Column) -> Column:
    """Runs between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits: the default search tokenizer."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


def mixed_tokens(text: Column) -> Column:
    """CJK runs as bigrams (a run of one as itself), other runs split at white space, in order."""
    runs = F.regexp_extract_all(text, F.lit(rf"([{CJK}]+|[^\s{CJK}]+)"))
    cut = F.transform(
        runs,
        lambda r: F.when(
            r.rlike(rf"^[{CJK}]") & (F.length(r) > 1),
            F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2)),
        ).otherwise(F.array(r)),
    )
    return F.flatten(cut)


def clean(text: Column, limit: int) -> Column:
    """Null as empty, NUL removed, cut to limit characters."""
    return F.substring(F.translate(F.coalesce(text, F.lit("")), "\x00", ""), 1, limit)


def clean_memory(text: Column) -> Column:
    """Trimmed, common HTML entities undone, control characters removed."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.trim(text), r"[\x00-\x1f\x7f-\x9f]", "")


def sanitize(text: Column) -> Column:
    """Trimmed; control characters other than tab, line feed and carriage return, and non-characters, removed."""
    return F.trim(F.regexp_replace(F.trim(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F￾￿]", ""))


def normalize_extracted(name: Column, is_entity: bool = False) -> Column:
    """Full-width brackets and dashes as ASCII, spaces beside CJK removed, paired quotes stripped; entities lose quotes at CJK."""
    name = F.translate(name, "（）—－", "()--")
    for before, after in ((CJK_COMMON, CJK_COMMON), (CJK_COMMON, BESIDE_CJK), (BESIDE_CJK, CJK_COMMON)):
        name = F.regexp_replace(name, rf"(?U)(?<=[{before}])\s+(?=[{after}])", "")
    for q in ('"', "'"):
        name = F.regexp_replace(name, f"(?s)^{q}(.*){q}$", "$1")
    if is_entity:
        name = F.translate(name, "“”‘’", "")
        name = F.regexp_replace(name, rf"['\"]+(?=[{CJK_COMMON}])", "")
        name = F.regexp_replace(name, rf"(?<=[{CJK_COMMON}])['\"]+", "")
    return name


def split_markers(text: Column, markers: list[str]) -> Column:
    """Parts between any of the markers, trimmed, without blanks."""
    pattern = "|".join(rf"\Q{m}\E" for m in markers)
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def preview(text: Column, limit: int = 250) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def is_float(text: Column) -> Column:
    return text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def has_cjk(text: Column) -> Column:
    return text.rlike(rf"[{CJK}]")


def estimate_tokens(text: Column) -> Column:
    """CJK characters / 1.5 plus others / 4, rounded down."""
    cjk = F.regexp_count(text, F.lit(rf"[{CJK}]"))
    return F.floor(cjk / 1.5 + (F.length(text) - cjk) / 4).cast("int")


def slugify(title: Column, fallback: str = "page") -> Column:
    """Letters, digits, - and _ kept, white space as -, runs of - collapsed; a fixed fallback instead of the clock."""
    s = F.regexp_replace(title, r"[^\p{L}\p{N}\-_ ]", "")
    s = F.regexp_replace(F.trim(s), r" +", "-")
    s = F.regexp_replace(F.trim(s, F.lit("-")), "-{2,}", "-")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def front_matter(text: Column, key: str) -> Column:
    """Value of a key in the leading --- block, or null."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    found = F.regexp_extract(block, rf"(?m)^{key}:[ ]*(.*)$", 1)
    return F.when(found != "", found)


def wiki_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"))


def identifier(name: Column) -> Column:
    """A column or table name: other characters than letters, digits and _ become _, a leading digit gets one before it."""
    s = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_]+", "_")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def sanitize_relation(name: Column) -> Column:
    for old, new in RELATION_NAMES:
        name = F.replace(name, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(name, "_+", "_"), F.lit("_"))


def entity_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def strip_reply(text: Column) -> Column:
    """A model's reply without its <think> block and code fence."""
    text = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(text, r"(?s)```(?:json|sql)?\s*(.*?)```", 1)
    return F.trim(F.when(fenced != "", fenced).otherwise(text))


def outer_array(text: Column) -> Column:
    """The outermost JSON array of a text, or null."""
    found = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def id_list(text: Column) -> Column:
    """Ids from a JSON list, a list in single quotes, or a comma-separated string."""
    body = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    parts = F.transform(F.split(body, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.filter(parts, lambda x: x != "")


def node_pair(text: Column) -> Column:
    """struct(a, b) from `A||B`, a JSON list of two, or a tuple string; null if none fits."""
    bars = F.split(text, r"\|\|")
    listed = id_list(F.regexp_replace(F.trim(text), r"^\(|\)$", ""))
    pair = F.when(F.size(bars) == 2, bars).when(F.size(listed) == 2, listed)
    return F.when(pair.isNotNull(), F.struct(F.trim(pair[0]).alias("a"), F.trim(pair[1]).alias("b")))


def sha32(text: Column) -> Column:
    """First 32 hex digits of SHA-256: ids of merged and graph records."""
    return F.substring(F.sha2(text, 256), 1, 32)
