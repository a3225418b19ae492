"""Text functions on Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript sees it: the Unicode property, and the byte order mark.
SPACE = r"[\s\x{FEFF}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: The same, character by character.
SPACES = " \t\n\x0b\f\r\ufeff\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

# Fixed values of the normal form: marks and punctuation that do not count.
MARKS = "■□☑✔✓"
PUNCTUATION = "()（）[]【】-_：:;；,，、\"“”'"
NARROW_PUNCTUATION = "()（）[]【】_-"
MODEL_PUNCTUATION = "._-/\\|,;:()[]{}<>"


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def no_space(c: Column) -> Column:
    return F.translate(c, SPACES, "")


def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    """Patterns replaced one after the other."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def normalize(c: Column) -> Column:
    """The normal form that dictionary texts are compared in; null becomes empty.

    Whatever it does but lowering is to replace or drop single characters, wherever they stand, so one pass over the text does it.
    """
    return F.translate(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "×" + MARKS + SPACES + PUNCTUATION, "x")


def normal_form(s: str | None) -> str:
    """normalize() of one text, for helpers that already hold it."""
    return (s or "").lower().translate(_NORMAL)


_NORMAL = str.maketrans("×", "x", MARKS + SPACES + PUNCTUATION)


def normalize_narrow(c: Column) -> Column:
    """The narrower form of stored aliases: keeps × and most punctuation."""
    return F.lower(F.translate(c, MARKS + " \t\n\x0b\f\r" + NARROW_PUNCTUATION, ""))


def model_key(c: Column) -> Column:
    """Model names without case, spaces and separators."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), SPACES + MODEL_PUNCTUATION, "")


# Spellings of attributes, in the order in which they apply.
ATTRIBUTE_SPELLINGS = (
    ("[，。；：、]", ""),
    ("[‐‑‒–—－]", "-"),
    (r"[×＊*]", "x"),
    ("(?i)平方厘米|平方公分|cm²|㎠", "cm2"),
    ("毫米", "mm"),
    ("厘米", "cm"),
    ("公斤", "kg"),
    ("千克", "kg"),
    ("每小时|/小时|每时", "/h"),
    ("/+", "/"),
)


def attribute_key(c: Column) -> Column:
    """Attribute values with one digit form, dash and unit spelling."""
    digits = F.translate(F.lower(trim(F.coalesce(c, F.lit("")))), "０１２３４５６７８９", "0123456789")
    return replaced(no_space(replaced(digits, *ATTRIBUTE_SPELLINGS)), (r"[()（）\[\]{}<>]", ""))


# Spellings of units, some of them from text read in a wrong encoding, in the order in which they apply.
UNIT_SPELLINGS = (
    ("鲁", "3"),
    ("虏", "2"),
    ("³", "3"),
    ("²", "2"),
    ("渭", "u"),
    ("碌", "u"),
    ("µ", "u"),
    ("μ", "u"),
    ("（", "("),
    ("）", ")"),
    ("／", "/"),
    ("姣", "/"),
    ("以内|以下|左右|约|大约|可调", ""),
    ("/每小时", "/h"),
    ("/小时", "/h"),
    ("每小时", "/h"),
    ("/每分钟", "/分钟"),
    ("/分钟", "/分钟"),
    (r"(?i)/hr\b", "/h"),
    (r"(?i)/hour\b", "/h"),
    ("/+", "/"),
)


def unit_key(c: Column) -> Column:
    """The normal form of a unit."""
    u = F.lower(no_space(replaced(trim(F.coalesce(c, F.lit(""))), *UNIT_SPELLINGS)))
    return F.when(u == "米", "m").when(u.isin("°", "°c"), "℃").otherwise(u)


def similarity(a: Column, b: Column) -> Column:
    """(longest - edit distance) / longest; 0 where either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), (longest - F.levenshtein(a, b)) / longest).otherwise(F.lit(0.0))


def slug(c: Column, fallback: str) -> Column:
    """Lower case words of ASCII letters and digits joined by _."""
    s = replaced(F.lower(trim(F.coalesce(c, F.lit("")))), ("[^a-z0-9]+", "_"), ("^_+|_+$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def tokens(c: Column, delimiters: str = "[,，、;；/|+\\n]") -> Column:
    """Distinct normalized parts between delimiters and white space, in order."""
    # the normal form of the whole text, whose only white space then is what stood between parts
    plain = F.translate(F.lower(F.regexp_replace(c, f"(?:{delimiters}|{SPACE})+", " ")), "×" + MARKS + PUNCTUATION, "x")
    return F.array_distinct(F.array_remove(F.split(plain, " "), ""))


def sanitize(c: Column) -> Column:
    """Without control characters; empty where there are two or more of them, or one of C1."""
    unsafe = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"
    bad = c.rlike(r"[\x{0080}-\x{009F}]") | (F.regexp_count(c, F.lit(unsafe)) >= 2)
    return F.when(c.isNull() | bad, F.lit("")).otherwise(F.regexp_replace(c, f"\\x00|{unsafe}", ""))


# Marks of options.
SELECTED, UNSELECTED = "☑✔✓■√", "□☐"


def option_marks(c: Column) -> Column:
    """Option marks, in brackets or not, as [SEL] and [ ]."""
    return replaced(c, (f"[\\[(（]\\s*[{SELECTED}]\\s*[\\])）]", "[SEL]"), (f"[\\[(（]\\s*[{UNSELECTED}]\\s*[\\])）]", "[ ]"), (f"[{SELECTED}]", "[SEL]"), (f"[{UNSELECTED}]", "[ ]"))


def options(c: Column) -> Column:
    """array<struct<selected, label>> of the options in a text."""
    found = F.regexp_extract_all(option_marks(c), F.lit(r"(\[(?:SEL| )\][^\[]*)"), F.lit(1))
    parsed = F.transform(found, lambda x: F.struct(x.startswith("[SEL]").alias("selected"), trim(F.regexp_replace(x, r"^\[(SEL| )\]", "")).alias("label")))
    return F.filter(parsed, lambda o: o["label"] != "")


def fenced_json(c: Column) -> Column:
    """The JSON object in a reply, inside a fence or not."""
    inner = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)```", 1)
    text = F.coalesce(F.nullif(inner, F.lit("")), trim(c))
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), text)


def ratio(c: Column) -> Column:
    """array<int> of a:b:c in percent, scaled where the sum is not 100."""
    parts = F.transform(F.split(c, ":"), lambda x: F.trim(x).try_cast("int"))
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    return F.when(total == 100, parts).otherwise(F.transform(parts, lambda x: F.floor(x / total * 100 + 0.5).cast("int")))


def cluster_id(*parts: Column) -> Column:
    """Parts as percent-encoded text joined by colons; null is empty."""
    encode = lambda c: F.replace(F.url_encode(F.coalesce(c.cast("string"), F.lit(""))), F.lit("+"), F.lit("%20"))
    return F.concat_ws(":", *map(encode, parts))


def pattern_key(*parts: Column) -> Column:
    """Parts joined by two pipes, double pipes inside made single."""
    return F.concat_ws("||", *[F.replace(F.coalesce(p.cast("string"), F.lit("")), F.lit("||"), F.lit("|")) for p in parts])


def quoted_big_integers(c: Column) -> Column:
    """JSON text with integers of 16 and more digits in quotes."""
    return F.regexp_replace(c, r"(:\s*)([0-9]{16,})(\s*[,}])", '$1"$2"$3')


def levels(*parts: Column) -> Column:
    """Non-empty parts joined by a slash."""
    return F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])
