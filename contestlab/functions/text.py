"""Text functions for names and titles, as Columns; Python only where Spark has no built-in."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

# Fixed values.
DIGITS = "०१२३४५६७८९"
ZERO_WIDTH = "​‌‍﻿"
MARKS = "॰·∘•*"
ZERO_MARKS = "०॰"
PUNCTUATION = r"""[.,;:!?"'`~^\\/|_\-‐-―‘-‟।॥()\[\]{}]+"""
CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ"
VOWEL_SIGNS = "ािीुूृेैोौ"
VIRAMA, NUKTA = "्", "़"
LATIN = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n",
    "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ल": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ळ": "l",
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "ा": "a", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
    "ं": "n", "ँ": "n", "ः": "h", "्": "", "़": "",
}
ROOM = r"(?i)(?:उत्तरी?|दक्षिणी?|पूर्वी?|पश्चिमी?)?\s*(?:भाग|कक्ष|part|room)\s*[-–]?\s*\d*"
_FROM, _TO = r"(?<![ऀ-ॿ])", r"(?![ऀ-ॿ])"
#: (pattern, type): the first that is found names the kind of building.
BUILDINGS = (
    (r"उत्क्रमित\s*म(?:ध्य)?\s*वि(?:द्यालय)?", "MIDDLE_SCHOOL"),
    (r"upgraded\s+middle\s+school", "MIDDLE_SCHOOL"),
    (r"\bu\s?m\s?s\b", "MIDDLE_SCHOOL"),
    (r"मध्य\s*विद्यालय", "MIDDLE_SCHOOL"),
    (_FROM + r"म\s*वि(?:द्यालय)?" + _TO, "MIDDLE_SCHOOL"),
    (r"middle\s+school", "MIDDLE_SCHOOL"),
    (r"\bm\s?s\b", "MIDDLE_SCHOOL"),
    (r"नव\s*प्रा(?:थमिक)?\s*वि(?:द्यालय)?", "PRIMARY_SCHOOL"),
    (_FROM + r"प्रा(?:थमिक)?\s*वि(?:द्यालय)?" + _TO, "PRIMARY_SCHOOL"),
    (r"new\s+primary\s+school", "PRIMARY_SCHOOL"),
    (r"primary\s+school", "PRIMARY_SCHOOL"),
    (r"\bn\s?p\s?s\b", "PRIMARY_SCHOOL"),
    (r"\bp\s?s\b", "PRIMARY_SCHOOL"),
    (r"\+\s*2\s*(?:उच्च|high)", "HIGH_SCHOOL"),
    (r"उच्च\s*वि(?:द्यालय)?", "HIGH_SCHOOL"),
    (_FROM + r"उ\s*वि(?:द्यालय)?" + _TO, "HIGH_SCHOOL"),
    (r"high\s+school", "HIGH_SCHOOL"),
    (r"\bh\s?s\b", "HIGH_SCHOOL"),
    (r"आंगनबाड़ी\s*(?:केंद्र|केन्द्र)?", "ANGANWADI"),
    (r"anganwadi(?:\s+kendra)?", "ANGANWADI"),
    (r"पंचायत\s*भवन", "PANCHAYAT_BHAWAN"),
    (r"panchayat\s+bhawan", "PANCHAYAT_BHAWAN"),
    (r"सामुदायिक\s*भवन", "COMMUNITY_HALL"),
    (r"community\s+(?:hall|centre|center)", "COMMUNITY_HALL"),
    (r"महाविद्यालय", "COLLEGE"),
    (r"college", "COLLEGE"),
    (r"कन्या\s*विद्यालय", "GIRLS_SCHOOL"),
    (r"girls?\s+school", "GIRLS_SCHOOL"),
    (r"स्वास्थ्य\s*(?:केंद्र|केन्द्र)", "HEALTH_CENTRE"),
    (r"health\s+(?:centre|center)", "HEALTH_CENTRE"),
    (r"विद्यालय", "SCHOOL"),
    (r"school", "SCHOOL"),
)
#: Words that some lists have and others don't.
DROPPED = (
    "रा", "राजकीय", "राज", "कृत", "govt", "government", "sarkari",
    "उत्तरी", "दक्षिणी", "पूर्वी", "पश्चिमी", "उत्तर", "दक्षिण", "पूर्व", "पश्चिम",
    "भाग", "part", "कक्ष", "room", "no", "sankhya",
    "का", "के", "की", "एवं", "और", "and", "at", "the",
)
AGE_BANDS = ((60, "60+"), (50, "50-59"), (40, "40-49"), (30, "30-39"), (20, "20-29"), (18, "18-19"))
BOOST_OVER, PREFIX_MOST, PREFIX_WEIGHT = 0.7, 4, 0.1
HAMMING, SHINGLE = 3, 3


def bound(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it."""
    return F.transform(F.array(x), f)[0]


def normalize_digits(text: Column) -> Column:
    return F.translate(text, DIGITS, "0123456789")


def parse_int(text: Column) -> Column:
    """The first integer, without thousands separators; NULL if there is none."""
    found = F.regexp_extract(F.translate(normalize_digits(text), ", ", ""), r"-?\d+", 0)
    return F.when(found != "", found.try_cast("bigint"))


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def by_few(texts: pa.Array, f, kind: pa.DataType, octets: int = 1 << 20) -> pa.Array:
    """f of each text, of which about so many bytes at a time are Python's: a batch may hold 10,000 long ones."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(ends // octets)) + 1).tolist(), len(texts)]
    parts = [pa.array([f(t) for t in texts.slice(a, b - a).to_pylist()], kind) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """NFC; ASCII texts are as they are, and don't become Python's."""
    if pc.all(pc.string_is_ascii(text), min_count=0).as_py():
        return text
    return by_few(text, lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), text.type)


def normalize(text: Column, compose: bool = True) -> Column:
    """NFC, no zero-width marks, white space collapsed; NULL gives ''."""
    t = F.coalesce(composed(text) if compose else text, F.lit(""))
    return _collapse(F.translate(F.translate(t, " ", " "), ZERO_WIDTH, ""))


def normalize_block(text: Column, compose: bool = True) -> Column:
    """normalize() for each line."""
    t = F.coalesce(composed(text) if compose else text, F.lit(""))
    lines = F.split(F.regexp_replace(t, "\r\n?", "\n"), "\n")
    return F.array_join(F.transform(lines, lambda x: _collapse(F.translate(F.translate(x, " ", " "), ZERO_WIDTH, ""))), "\n")


def strip_punctuation(text: Column) -> Column:
    return _collapse(F.regexp_replace(text, PUNCTUATION, " "))


def fold(text: Column, compose: bool = True) -> Column:
    """Two spellings that differ only in case, script of digits, spacing or punctuation give one text."""
    return F.lower(_collapse(F.translate(strip_punctuation(normalize_digits(normalize(text, compose))), MARKS, " " * len(MARKS))))


def canonical_building(text: Column, rules=BUILDINGS, dropped=DROPPED) -> Column:
    """The building's type, then what is left of its name."""
    t = normalize_digits(F.translate(normalize(text), ZERO_MARKS, " " * len(ZERO_MARKS)))
    t = F.lower(F.regexp_replace(F.regexp_replace(t, r"\+\s*2\s*", " "), ROOM, " "))
    t = _collapse(F.regexp_replace(F.translate(t, MARKS, " " * len(MARKS)), PUNCTUATION, " "))
    upper = lambda w: w.rlike("^[A-Z_]+$")

    def typed(name: Column) -> Column:
        out = name
        for pattern, kind in reversed(rules):  # the first rule is the outermost
            rule = f"(?i){pattern}"
            out = F.when(name.rlike(rule), F.regexp_replace(name, rule, f" {kind} ")).otherwise(out)
        return out

    words = F.filter(F.split(bound(t, typed), r"\s+"), lambda w: (w != "") & ~w.isin(*dropped))
    return bound(words, lambda ws: F.array_join(F.concat(F.filter(ws, upper), F.filter(ws, lambda w: ~upper(w))), " "))


def building_type(canonical: Column) -> Column:
    found = F.regexp_extract(canonical, r"(?:^| )([A-Z_]+)(?: |$)", 1)
    return F.when(found != "", found)


def to_latin(text: Column, compose: bool = True) -> Column:
    """Devanagari as lower-case Latin, with the inherent a of consonants."""
    table = F.create_map(*(F.lit(x) for pair in LATIN.items() for x in pair))

    def letters(plain: Column) -> Column:
        voiced = F.regexp_replace(plain, f"([{CONSONANTS}])(?![{VOWEL_SIGNS}{VIRAMA}{NUKTA}])", "$1a")
        each = F.transform(F.split(voiced, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.when(c.rlike(r"^[\x00-\x7F]$"), c), F.lit("")))
        return F.lower(F.when(plain.rlike("[ऀ-ॿ]"), _collapse(F.array_join(each, ""))).otherwise(plain))

    return bound(normalize(text, compose), letters)


def match_key(building: Column, place: Column | None = None) -> Column:
    parts = [canonical_building(building)] + ([normalize(place)] if place is not None else [])
    return F.replace(to_latin(F.concat_ws(" ", *parts), compose=False), F.lit(" "), F.lit(""))


def last_token(name: Column) -> Column:
    return F.coalesce(F.element_at(F.split(normalize(name), " "), -1), F.lit(""))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of words."""
    x, y = (F.filter(F.array_distinct(F.split(F.coalesce(c, F.lit("")), r"\s+")), lambda w: w != "") for c in (a, b))
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), shared / F.greatest(F.size(x) + F.size(y) - shared, F.lit(1))).otherwise(0.0)


@lru_cache(1 << 14)
def _places(name: str) -> dict[str, int]:
    """For each letter the bits of where it stands."""
    places: dict[str, int] = {}
    for i, ch in enumerate(name):
        places[ch] = places.get(ch, 0) | 1 << i
    return places


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach, places, free, pairs = max(max(len(a), len(b)) // 2 - 1, 0), _places(b), (1 << len(b)) - 1, []
    for i, ch in enumerate(a):
        # the first free place of this letter within reach
        found = places.get(ch, 0) & free & (1 << i + reach + 1) - 1
        found = found >> i - reach << i - reach if i > reach else found
        if found:
            free ^= found & -found
            pairs.append(ch)
    if not pairs:
        return 0.0
    swapped = sum(x != y for x, y in zip(pairs, (y for j, y in enumerate(b) if not free >> j & 1), strict=True)) // 2
    m = len(pairs)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str | None, b: str | None) -> float:
    if a is None or b is None:
        return 0.0
    score = jaro(a, b)
    if score <= BOOST_OVER or score == 1.0:
        return score
    same = next((i for i, (x, y) in enumerate(zip(a[:PREFIX_MOST], b[:PREFIX_MOST], strict=False)) if x != y), min(len(a), len(b), PREFIX_MOST))
    return score + same * PREFIX_WEIGHT * (1 - score)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity."""
    known: dict = {}
    return pd.Series([known[p] if p in known else known.setdefault(p, jaro_winkler(*p)) for p in zip(a, b, strict=True)], dtype="float64")


class _Bits(dict):
    """Three code points in one number -> the row of their digest's 64 bits; grows as shingles are met."""

    def __init__(self):
        self.rows = np.zeros((1024, 64), np.uint8)

    def __missing__(self, key: int) -> int:
        shingle = "".join(chr(key >> n & 0x1FFFFF) for n in (42, 21, 0))
        if len(self) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self[key] = n = len(self)
        self.rows[n] = np.unpackbits(np.frombuffer(hashlib.md5(shingle.encode()).digest()[:8], np.uint8))
        return n


#: Shingles that a process remembers, about 30 MB; beyond, it begins anew.
REMEMBERED = 100_000
_bits = _Bits()


def simhash64(folded: str | None) -> int:
    """Signed 64-bit SimHash of a folded text over its 3-character shingles."""
    global _bits
    t = (folded or "").replace(" ", "")
    if not t:
        return 0
    if len(t) <= SHINGLE:
        return int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big", signed=True)
    if len(_bits) > REMEMBERED:
        _bits = _Bits()
    points = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
    keys, counts = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
    rows = list(map(_bits.__getitem__, keys.tolist()))
    votes = counts.astype(np.float64) @ _bits.rows[rows].astype(np.float64)  # whole numbers, so exact
    return int(np.packbits(2 * votes > len(t) - 2).view(">i8")[0])


@F.arrow_udf(LongType())
def simhash(folded: pa.Array) -> pa.Array:
    return by_few(folded, simhash64, pa.int64())


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def url_hash(url: Column) -> Column:
    """SHA-256 of a url without query, fragment and closing slashes."""
    clean = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"[?#][\s\S]*$", "")
    return F.sha2(F.regexp_replace(clean, "/+$", ""), 256)


def title_hash(title: Column) -> Column:
    return F.sha2(fold(title), 256)


def detect_lang(text: Column) -> Column:
    """hi, en or hinglish by the counts of letters."""
    t = F.coalesce(text, F.lit(""))
    deva, latin = F.length(F.regexp_replace(t, "[^ऀ-ॿ]", "")), F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return F.when((deva > 0) & (latin > deva), "hinglish").when(deva > 0, "hi").otherwise("en")


def blocked(text: Column, patterns) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def split_name_place(text: Column) -> Column:
    """struct(name, place): the first and the last part of a text cut at separators."""
    parts = F.filter(F.transform(F.split(normalize(text), r"\s*[,;–—-]\s*"), F.trim), lambda p: p != "")
    return F.struct(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("name"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("").alias("place"))


def header_key(cell: Column) -> Column:
    """A header cell without punctuation and symbols, lower case."""
    return F.lower(_collapse(F.regexp_replace(normalize(cell), r"[\p{P}\p{S}]+", " ")))


def bracket_text(cell: Column) -> Column:
    """The text of the last pair of brackets."""
    found = F.regexp_extract_all(cell, F.lit(r"[(\[{]([^()\[\]{}]*)[)\]}]"), 1)
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def age_band(age: Column) -> Column:
    band = F.lit(None).cast("string")
    for least, name in reversed(AGE_BANDS):
        band = F.when(age >= least, name).otherwise(band)
    return band


def recency(year: Column, now: int, half: int = 20) -> Column:
    """How fresh a census of that year is, from 1 to 0 in `half` years; 0 if unknown."""
    return F.when(year.isNotNull() & (year != 0), F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), now - year) / float(half))).otherwise(0.0)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def geocode_confidence(importance: Column, village: Column) -> Column:
    c = F.least(F.lit(0.9), 0.4 + F.coalesce(importance, F.lit(0.0)))
    return F.when(village, F.least(c, F.lit(0.6))).otherwise(c)


def first_object(text: Column) -> Column:
    """From the first { to the last }; NULL if there is no such part."""
    found = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    return F.when(found != "", found)


def ramp(value: Column, low: float, high: float, steps: int) -> Column:
    """Index of a colour on a ramp, from 0; values beyond its ends take the end."""
    at = F.floor((value - low) * steps / (high - low))
    return F.least(F.greatest(at, F.lit(0)), F.lit(steps - 1)).cast("int")


@F.pandas_udf(StringType())
def _latin(plain: pd.Series) -> pd.Series:
    """to_latin() of normalised text, for SQL."""
    signs = frozenset(VOWEL_SIGNS + VIRAMA + NUKTA)

    def letters(t: str) -> str:
        if not any("\u0900" <= c <= "\u097f" for c in t):
            return t.lower()
        found = (LATIN.get(c, c if c.isascii() else "") + ("a" if c in CONSONANTS and n not in signs else "") for c, n in zip(t, t[1:] + " ", strict=True))
        return " ".join("".join(found).split()).lower()

    return plain.map(lambda t: letters(" ".join(unicodedata.normalize("NFC", t or "").replace("\u00a0", " ").translate({ord(z): None for z in ZERO_WIDTH}).split())))


def register(spark: SparkSession) -> None:
    """Install jaro_winkler(a, b), simhash64(text) and to_latin(text) as SQL functions; simhash64 takes folded text."""
    for name, f in {"jaro_winkler": similarity, "simhash64": simhash, "to_latin": _latin}.items():
        spark.udf.register(name, f)
