"""Text functions over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.functions import keywords as K
from contestlab.functions import text as T

#: Personal lookups that aren't answered. Fixed values, on lower-cased text.
BLOCKED = (
    r"\b[a-z]{3}\d{7}\b",
    r"\b[a-z]{2}/\d{2}/\d{3}/\d{6}\b",
    r"\bepic\b",
    r"वोटर\s*आईडी",
    r"मतदाता\s*पहचान",
    r"(?:is|was)\s+(?:\w+\s+){1,4}(?:on|in)\s+the\s+(?:voter|electoral)\s+(?:roll|list)",
    r"(?:voter|elector)\s+(?:named|called)\s+\w+",
    r"\b(?:phone|mobile|contact)\s*(?:number|no)\b",
    r"\b(?:home|house|residential)\s*address\b",
    r"मकान\s*(?:संख्या|नंबर)",
    r"(?:किस|कौन)\s*(?:व्यक्ति|आदमी|शख्स)\s*(?:की|का)\s*जाति",
    r"\bcaste\s+of\s+(?:mr|mrs|ms|shri|smt)\b",
    r"(?:what|which)\s+caste\s+is\s+\w+",
    r"(?:list|export|download|give me)\s+(?:all\s+)?(?:the\s+)?voters?\b",
    r"(?:मतदाता|वोटर)\s*(?:सूची|लिस्ट)\s*(?:दो|दीजिए|निकालो|भेजो)",
)
BOX = (23.9, 24.8, 85.8, 86.6)
KINDS = ("Primary School", "Govt. High School", "Community Hall", "Health Centre", "Panchayat Bhawan")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, key: str, /, **columns):
    """key and the columns, over a whole table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, name).select(key, *(make().alias(c) for c, make in columns.items()))

    return query


def _building():
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % len(KINDS) + 1).cast("int"))
    return F.concat(kind, F.lit(" "), "p_name", F.lit(" (Part-"), F.col("p_size").cast("string"), F.lit(")"))


def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of part names that share their first word."""
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    a, b = names.select(F.col("p_name").alias("a"), F.split("p_name", " ")[0].alias("w")), names.select(F.col("p_name").alias("b"), F.split("p_name", " ")[0].alias("w"))
    pairs = a.join(b, "w").filter("a < b")
    return pairs.select("a", "b", T.similarity("a", "b").alias("similarity"), T.token_overlap(F.col("a"), F.col("b")).alias("overlap"))


def title_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.simhash(T.fold(F.col("text"))).alias("simhash"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages with what they lead to, by their file extension."""
    link = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"#]+)'), 1)).alias("link")
    kind = F.when(F.lower("link").rlike(r"\.pdf($|\?)"), "pdf").when(F.col("link").rlike("^https?://"), "page").otherwise("local")
    return read(spark, sf_dir, "pages").select("page_id", link).groupBy("page_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("links"))


def geo_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name one of the keywords, in the order of the keywords."""
    found = K.named_in(T.fold(F.col("text")), ["zwischen", "chtischen", "elleair", "tioning", "thouan"])
    rows = read(spark, sf_dir, "documents").select("doc_id", found.alias("found"))
    return rows.filter("size(found) > 0").select("doc_id", F.array_join("found", ",").alias("found"))


def geo_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of many areas each document names: the areas' names are the longer words of the benchmark's texts."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("name")).filter(F.length("name") > 6).distinct()
    areas = words.unionByName(words.select(F.concat(F.lit("Ward "), "name").alias("name")))  # too general to look for
    rows = read(spark, sf_dir, "documents").select("doc_id", K.named_in(T.fold(F.col("text")), K.area_keywords(areas)).alias("found"))
    return rows.select("doc_id", F.size("found").alias("areas")).filter("areas > 0")


def _of(values, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three syllables and one with a conjunct, spelt from each part's number: over all parts every consonant meets every vowel sign, and none."""
    k, consonants, signs = F.col("p_partkey"), tuple(T.CONSONANTS), (*T.VOWEL_SIGNS, "")
    one = lambda j: F.concat(_of(consonants, (k * 7 + j * 13) % len(consonants)), _of(signs, (k + j * 5) % len(signs)))
    conjunct = F.concat(_of(consonants, k % len(consonants)), F.lit(T.VIRAMA), one(3))
    return read(spark, sf_dir, "part").select("p_partkey", T.to_latin(F.concat(one(0), one(1), one(2), F.lit(" "), conjunct)).alias("latin"))


#: Names of buildings in both scripts, short and long, and their types.
BUILDING_NAMES = (
    ("उत्क्रमित मध्य विद्यालय", "MIDDLE_SCHOOL"), ("उत्क्रमित म वि", "MIDDLE_SCHOOL"), ("Upgraded Middle School", "MIDDLE_SCHOOL"), ("U.M.S.", "MIDDLE_SCHOOL"), ("मध्य विद्यालय", "MIDDLE_SCHOOL"), ("म वि", "MIDDLE_SCHOOL"), ("Middle School", "MIDDLE_SCHOOL"), ("M.S.", "MIDDLE_SCHOOL"),
    ("नव प्राथमिक विद्यालय", "PRIMARY_SCHOOL"), ("प्रा वि", "PRIMARY_SCHOOL"), ("प्राथमिक विद्यालय", "PRIMARY_SCHOOL"), ("New Primary School", "PRIMARY_SCHOOL"), ("primary  school", "PRIMARY_SCHOOL"), ("N.P.S.", "PRIMARY_SCHOOL"), ("P S", "PRIMARY_SCHOOL"),
    ("उच्च विद्यालय", "HIGH_SCHOOL"), ("उ वि", "HIGH_SCHOOL"), ("High School", "HIGH_SCHOOL"), ("H.S.", "HIGH_SCHOOL"), ("आंगनबाड़ी केंद्र", "ANGANWADI"), ("Anganwadi Kendra", "ANGANWADI"), ("पंचायत भवन", "PANCHAYAT_BHAWAN"), ("PANCHAYAT BHAWAN", "PANCHAYAT_BHAWAN"),
    ("सामुदायिक भवन", "COMMUNITY_HALL"), ("Community Centre", "COMMUNITY_HALL"), ("महाविद्यालय", "COLLEGE"), ("College", "COLLEGE"), ("कन्या विद्यालय", "GIRLS_SCHOOL"), ("Girls School", "GIRLS_SCHOOL"), ("स्वास्थ्य केन्द्र", "HEALTH_CENTRE"), ("Health Center", "HEALTH_CENTRE"), ("विद्यालय", "SCHOOL"), ("School", "SCHOOL"),
)


def building_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as buildings named in all the ways there are: the type, and what is left of the name."""
    name = F.concat(_of([n for n, _ in BUILDING_NAMES], F.col("p_partkey") % len(BUILDING_NAMES)), F.lit(", "), F.initcap("p_name"))
    canonical = T.canonical_building(name)
    return read(spark, sf_dir, "part").select("p_partkey", canonical.alias("canonical"), T.building_type(canonical).alias("kind"))


_HINDI = "मतदान केंद्र"


def mixed_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments with so many words of Hindi beside them."""
    text = F.concat(F.repeat(F.lit(f"{_HINDI} "), (F.col("c_custkey") % 4).cast("int")), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(""))
    return read(spark, sf_dir, "customer").select("c_custkey", T.detect_lang(text).alias("script"))


_D = lambda **c: _over("documents", "doc_id", **c)
QUERIES = {
    "str_normalize_digits": _over("customer", "c_custkey", digits=lambda: T.normalize_digits(F.translate("c_name", "0123456789", T.DIGITS))),
    "str_parse_int": _over("customer", "c_custkey", number=lambda: T.parse_int(F.col("c_name")), none=lambda: T.parse_int(F.col("c_mktsegment"))),
    "str_normalize": _D(text=lambda: T.normalize(F.col("text"))),
    "str_normalize_block": _D(text=lambda: T.normalize_block(F.col("text"))),
    "str_strip_punct": _D(folded=lambda: T.fold(F.col("text"))),
    "str_canonical_building": _over("part", "p_partkey", canonical=lambda: T.canonical_building(_building())),
    "str_building_type": _over("part", "p_partkey", kind=lambda: T.building_type(T.canonical_building(_building()))),
    "str_translit": _over("part", "p_partkey", latin=lambda: T.to_latin(F.concat(F.lit("महतो "), "p_name"))),
    "str_translit_syllables": syllables,
    "str_building_names": building_names,
    "str_detect_lang_mixed": mixed_scripts,
    "str_last_token": _over("part", "p_partkey", last=lambda: T.last_token(F.col("p_name")), key=lambda: T.match_key(_building())),
    "str_jaro_winkler": near_names,
    "str_header_norm": _over("orders", "o_orderkey", header=lambda: T.header_key(F.col("o_orderpriority")), bracket=lambda: T.bracket_text(F.concat(F.lit("x ("), "o_orderstatus", F.lit(") y")))),
    "str_split_name_village": _over("orders", "o_orderkey", parts=lambda: F.concat_ws("|", T.split_name_place(F.col("o_orderpriority"))["name"], T.split_name_place(F.col("o_orderpriority"))["place"])),
    "str_detect_lang": _D(script=lambda: T.detect_lang(F.col("text"))),
    "str_blocked_patterns": _D(blocked=lambda: T.blocked(F.col("text"), BLOCKED)),
    "hash_url": _over("pages", "page_id", hash=lambda: T.url_hash(F.col("url"))),
    "hash_title": _D(hash=lambda: T.title_hash(F.col("text"))),
    "hash_simhash64": title_simhash,
    "scan_html_links": html_links,
    "geo_keyword_filter": geo_keywords,
    "geo_keyword_areas": geo_areas,
    "date_age_days": _over("orders", "o_orderkey", days=lambda: F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).cast("long")),
    "date_recency": _over("orders", "o_orderkey", recency=lambda: T.recency(F.year("o_orderdate"), 2011)),
    "json_get": _over("events", "event_id", k=lambda: F.get_json_object("props", "$.k")),
    "json_extract_object": _over("events", "event_id", object=lambda: T.first_object(F.concat(F.lit("so: "), "props", F.lit(" .")))),
    "math_bin": lambda spark, sf_dir: read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.age_band(F.col("l_quantity").cast("int") * 2).alias("band")),
    "math_bbox": _over("customer", "c_custkey", inside=lambda: T.in_box(F.lit(23.0) + F.col("c_custkey") % 30 / F.lit(10.0), F.lit(85.0) + F.col("c_custkey") % 20 / F.lit(10.0), BOX)),
    "math_conf_cap": _over("customer", "c_custkey", confidence=lambda: T.geocode_confidence(F.col("c_custkey") % 10 / F.lit(10.0), F.col("c_custkey") % 3 == 0)),
    "math_color_bin": _over("customer", "c_custkey", step=lambda: T.ramp(F.col("c_acctbal"), 0.0, 8000.0, 9)),
}



def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"


def _normal(x: str) -> str:
    return _squeeze(f"translate(translate(coalesce(nfc_normalize({x}), ''), chr(160), ' '), '{T.ZERO_WIDTH}', '')")


_PUNCT = "[.,;:!?\"''`~^\\\\/|_\\-‐-―‘-‟।॥()\\[\\]{}]+"


def _fold(x: str) -> str:
    plain = _squeeze(f"regexp_replace({_normal(x)}, '{_PUNCT}', ' ', 'g')")
    return f"lower({_squeeze(f'''translate({plain}, '{T.MARKS}', '{' ' * len(T.MARKS)}')''')})"


_NAME = f"[{', '.join(f'''{chr(39)}{k}{chr(39)}''' for k in KINDS)}][p_size % {len(KINDS)} + 1] || ' ' || p_name || ' (Part-' || p_size || ')'"
_CANON = f"['PRIMARY_SCHOOL', 'HIGH_SCHOOL', 'COMMUNITY_HALL', 'HEALTH_CENTRE', 'PANCHAYAT_BHAWAN'][p_size % {len(KINDS)} + 1]"


def _syllables_sql() -> str:
    """The Latin of each syllable by its consonant and sign, from the table of fixed values."""
    listed = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    consonants, signs = listed(T.LATIN[c] for c in T.CONSONANTS), listed([*(T.LATIN[v] for v in T.VOWEL_SIGNS), "a"])
    n, m = len(T.CONSONANTS), len(T.VOWEL_SIGNS) + 1
    one = lambda j: f"{consonants}[(p_partkey * 7 + {j * 13}) % {n} + 1] || {signs}[(p_partkey + {j * 5}) % {m} + 1]"
    return f"SELECT p_partkey, {one(0)} || {one(1)} || {one(2)} || ' ' || {consonants}[p_partkey % {n} + 1] || {one(3)} AS latin FROM part"


SIMHASH_SQL = f"""WITH t AS (SELECT doc_id, replace({_fold("text")}, ' ', '') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN length(t) <= 3 THEN [t] ELSE [t[CAST(i AS BIGINT):CAST(i + 2 AS BIGINT)] FOR i IN range(1, length(t) - 1)] END AS s FROM t WHERE t != ''),
h AS (SELECT doc_id, CAST('0x' || md5(unnest(s))[1:16] AS UBIGINT) AS h FROM s),
v AS (SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum(CAST((h >> {b}) & 1 AS BIGINT)) > count(*) THEN {1 << b}::HUGEINT ELSE 0::HUGEINT END" for b in range(64))} AS v FROM h GROUP BY 1)
SELECT d.doc_id, CAST(CASE WHEN coalesce(v, 0) >= 9223372036854775808::HUGEINT THEN v - 18446744073709551616::HUGEINT ELSE coalesce(v, 0) END AS BIGINT) AS simhash FROM documents d LEFT JOIN v USING (doc_id)"""
SQL = {
    "str_normalize_digits": "SELECT c_custkey, c_name AS digits FROM customer",
    "str_parse_int": "SELECT c_custkey, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS number, CAST(NULL AS BIGINT) AS none FROM customer",
    "str_normalize": f"SELECT doc_id, {_normal('text')} AS text FROM documents",
    "str_normalize_block": "SELECT doc_id, array_to_string([" + _squeeze(f"translate(translate(x, chr(160), ' '), '{T.ZERO_WIDTH}', '')") + " FOR x IN string_split(regexp_replace(coalesce(nfc_normalize(text), ''), '\r\n?', '\n', 'g'), '\n')], '\n') AS text FROM documents",
    "str_strip_punct": f"SELECT doc_id, {_fold('text')} AS folded FROM documents",
    "str_canonical_building": f"SELECT p_partkey, {_CANON} || ' ' || p_name AS canonical FROM part",
    "str_building_type": f"SELECT p_partkey, {_CANON} AS kind FROM part",
    "str_translit_syllables": _syllables_sql(),
    "str_building_names": f"SELECT p_partkey, kind || ' ' || lower(p_name) AS canonical, kind FROM (SELECT p_partkey, p_name, [{', '.join(f"'{k}'" for _, k in BUILDING_NAMES)}][p_partkey % {len(BUILDING_NAMES)} + 1] AS kind FROM part)",
    "str_detect_lang_mixed": f"""SELECT c_custkey, CASE WHEN h > 0 AND l > h THEN 'hinglish' WHEN h > 0 THEN 'hi' ELSE 'en' END AS script FROM (
  SELECT c_custkey, {sum(0x900 <= ord(c) <= 0x97F for c in _HINDI)} * (c_custkey % 4) AS h, CASE WHEN c_custkey % 3 != 0 THEN length(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) ELSE 0 END AS l FROM customer)""",
    "str_translit": "SELECT p_partkey, 'mahato ' || p_name AS latin FROM part",
    "str_last_token": f"SELECT p_partkey, string_split(p_name, ' ')[-1] AS last, replace(lower({_CANON} || ' ' || p_name), ' ', '') AS key FROM part",
    "str_jaro_winkler": """SELECT a, b, jaro_winkler_similarity(a, b) AS similarity, CAST(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) AS DOUBLE) / len(list_distinct(string_split(a, ' ') || string_split(b, ' '))) AS overlap
  FROM (SELECT DISTINCT p_name AS a FROM part) JOIN (SELECT DISTINCT p_name AS b FROM part) ON a < b AND string_split(a, ' ')[1] = string_split(b, ' ')[1]""",
    "str_header_norm": "SELECT o_orderkey, lower(trim(replace(o_orderpriority, '-', ' '))) AS header, o_orderstatus AS bracket FROM orders",
    "str_split_name_village": "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, '-') THEN replace(o_orderpriority, '-', '|') ELSE o_orderpriority || '|' END AS parts FROM orders",
    "str_detect_lang": "SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[ऀ-ॿ]') THEN 'hi' ELSE 'en' END AS script FROM documents",
    "str_blocked_patterns": "SELECT doc_id, coalesce(regexp_matches(lower(text), '" + "|".join(f"(?:{p})" for p in BLOCKED) + "'), false) AS blocked FROM documents",
    "hash_url": "SELECT page_id, sha256(regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '[?#](?s:.*)$', ''), '/+$', '')) AS hash FROM pages",
    "hash_title": f"SELECT doc_id, sha256({_fold('text')}) AS hash FROM documents",
    "hash_simhash64": SIMHASH_SQL,
    "scan_html_links": """SELECT page_id, CASE WHEN regexp_matches(lower(link), '\\.pdf($|\\?)') THEN 'pdf' WHEN regexp_matches(link, '^https?://') THEN 'page' ELSE 'local' END AS kind, count(*) AS links
  FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS link FROM pages) GROUP BY 1, 2""",
    "geo_keyword_filter": f"""SELECT doc_id, array_to_string(list_filter(['zwischen', 'chtischen', 'elleair', 'tioning', 'thouan'], lambda k: contains(f, k)), ',') AS found FROM (SELECT doc_id, {_fold("text")} AS f FROM documents)
  WHERE len(list_filter(['zwischen', 'chtischen', 'elleair', 'tioning', 'thouan'], lambda k: contains(f, k))) > 0""",
    "geo_keyword_areas": f"""WITH k AS MATERIALIZED (SELECT DISTINCT lower(w) AS k FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) > 6 AND NOT starts_with(lower(w), 'ward')),
  d AS MATERIALIZED (SELECT doc_id, {_fold("text")} AS f FROM documents)
  SELECT doc_id, CAST(count(*) AS INT) AS areas FROM d JOIN k ON contains(f, k) GROUP BY 1""",
    "date_age_days": "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS days FROM orders",
    "date_recency": "SELECT o_orderkey, greatest(0.0::DOUBLE, 1 - greatest(0, 2011 - year(o_orderdate)) / 20.0::DOUBLE) AS recency FROM orders",
    "json_get": "SELECT event_id, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS k FROM events",
    "json_extract_object": "SELECT event_id, props AS object FROM events",
    "math_bin": """SELECT l_orderkey, l_linenumber, CASE WHEN a >= 60 THEN '60+' WHEN a >= 50 THEN '50-59' WHEN a >= 40 THEN '40-49' WHEN a >= 30 THEN '30-39' WHEN a >= 20 THEN '20-29' WHEN a >= 18 THEN '18-19' END AS band
  FROM (SELECT *, CAST(l_quantity AS INT) * 2 AS a FROM lineitem)""",
    "math_bbox": f"SELECT c_custkey, 23.0::DOUBLE + c_custkey % 30 / 10.0::DOUBLE BETWEEN {BOX[0]}::DOUBLE AND {BOX[1]}::DOUBLE AND 85.0::DOUBLE + c_custkey % 20 / 10.0::DOUBLE BETWEEN {BOX[2]}::DOUBLE AND {BOX[3]}::DOUBLE AS inside FROM customer",
    "math_conf_cap": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN least(0.6::DOUBLE, least(0.9::DOUBLE, 0.4::DOUBLE + c_custkey % 10 / 10.0::DOUBLE)) ELSE least(0.9::DOUBLE, 0.4::DOUBLE + c_custkey % 10 / 10.0::DOUBLE) END AS confidence FROM customer",
    "math_color_bin": "SELECT c_custkey, CAST(least(greatest(floor(c_acctbal * 9 / 8000.0::DOUBLE), 0), 8) AS INT) AS step FROM customer",
}
