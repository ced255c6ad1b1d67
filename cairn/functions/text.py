"""

Unicode normal forms are not in Spark; the four functions that need them take an Arrow UDF for that
step alone. Null stays null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that names are compared without, in order of removal.
GENERIC_TERMS = ["食べ放題", "本店", "店", "個室", "居酒屋", "焼肉", "しゃぶしゃぶ", "本格", "ホルモン"]
# Prefectures in official order.
PREFECTURES = [
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県",
    "東京都", "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県",
    "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県",
    "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
]
KANJI_DIGITS = "〇一二三四五六七八九"


def _mapped(function, returns: str = "string"):
    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else function(v))

    return run


def nfkc(x: Column, fold: bool = False) -> Column:
    """Normal form KC, case-folded on demand."""
    return _mapped((lambda v: unicodedata.normalize("NFKC", v).casefold()) if fold else (lambda v: unicodedata.normalize("NFKC", v)))(x)


def strong_key(x: Column) -> Column:
    """NFKC, case-folded, letters and numbers only."""
    return F.regexp_replace(nfkc(x, fold=True), r"[^\p{L}\p{N}]", "")


def light_key(x: Column) -> Column:
    """NFKC without blanks, lower case; null is empty."""
    return F.trim(F.lower(F.translate(nfkc(F.coalesce(x, F.lit(""))), " 　", "")))


def geo_key(x: Column) -> Column:
    """NFKC without white space."""
    return F.regexp_replace(nfkc(x), r"(?U)\s", "")


def lower_key(x: Column) -> Column:
    """NFKC, lower case."""
    return F.lower(nfkc(x))


def name_key(x: Column) -> Column:
    """P5: no white space, lower case; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(x, r"(?U)\s+", "")), F.lit(""))


def phone_key(x: Column) -> Column:
    """Decimal digits of any script; none is null."""
    return F.nullif(F.regexp_replace(x, r"\P{Nd}", ""), F.lit(""))


def entity_key(name: Column, address: Column) -> Column:
    """Both light keys."""
    return F.concat_ws("||", light_key(name), light_key(address))


def _odd_space(x: Column, compat: bool) -> Column:
    # Q3: the compatible class is backslash, the letter s and the wide blank.
    return F.regexp_replace(x, r"[\\s\x{3000}]+" if compat else r"(?U)\s+", " ")


def strip_branch(x: Column, compat: bool = True) -> Column:
    """Without a last token that ends in 店."""
    token = F.split(F.trim(_odd_space(nfkc(x), compat)), " ")
    return F.when((F.size(token) >= 2) & F.element_at(token, -1).endswith("店"), F.array_join(F.slice(token, 1, F.greatest(F.size(token) - 1, F.lit(0))), " ")).otherwise(F.array_join(token, " "))


def match_key(x: Column, compat: bool = True) -> Column:
    """What similar names are compared by."""
    out = F.regexp_replace(light_key(strip_branch(x, compat)), r"[、，．・/／\\\-－‑–—―ー]", "")
    for term in GENERIC_TERMS:
        out = F.replace(out, F.lit(term), F.lit(""))
    return out


def overlap_name(x: Column, compat: bool = True) -> Column:
    """Without 本店 and 店, marks (Q4: kept when compatible) and accents, lower case."""
    out = F.replace(F.replace(nfkc(x), F.lit("本店"), F.lit("")), F.lit("店"), F.lit(""))
    out = out if compat else F.regexp_replace(out, r"[\p{P}\p{S}\s]", "")
    return F.lower(_mapped(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))(out))


def address_block(x: Column) -> Column:
    """Through the first 丁目, else through the first number and hyphen, else null."""
    a = F.trim(F.replace(nfkc(x), F.lit("　"), F.lit("")))
    part = lambda p: F.nullif(F.regexp_extract(a, p, 1), F.lit(""))
    return F.coalesce(part(r"^(.+?丁目)"), part(r"^(.+?\d+-)"))


def url_key(x: Column) -> Column:
    """Without fragment, query and closing slashes."""
    return F.regexp_replace(F.substring_index(F.substring_index(F.trim(x), "#", 1), "?", 1), "/+$", "")


def listing_id(url: Column, hosts: list[str], path: str = r"(?i)^/str(J\d+)(?:/|$)") -> Column:
    """The upper-cased id in the path of a https URL of one of the hosts, else null."""
    u = F.trim(url)
    ok = (F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))) == "https") & F.lower(F.try_parse_url(u, F.lit("HOST"))).isin(hosts)
    return F.when(ok, F.nullif(F.upper(F.regexp_extract(F.try_parse_url(u, F.lit("PATH")), path, 1)), F.lit("")))


def loose_listing_id(url: Column) -> Column:
    """A letter and digits after /str anywhere; case counts."""
    return F.nullif(F.regexp_extract(url, r"/str([A-Z]\d+)", 1), F.lit(""))


def tokens(x: Column) -> Column:
    """Comma-separated tokens, trimmed, lower case, each once; null has none."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def valid_legacy_id(x: Column) -> Column:
    """The id, or the empty string."""
    v = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(v.rlike("^legacy_[0-9a-f]{20}$"), v).otherwise("")


def legacy_id(*attributes: Column) -> Column:
    """An id from public attributes by their strong keys."""
    return F.concat(F.lit("legacy_"), F.left(F.sha2(F.concat_ws("\u001f", *(strong_key(F.coalesce(a, F.lit(""))) for a in attributes)), 256), F.lit(20)))


def lineage(url: Column, legacy: Column, current: str = "hotpepper", old: str = "legacy_local") -> Column:
    """P20: names of the sources that a row has an id of; null if none."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.nullif(F.concat_ws(",", F.when(has(url), F.lit(current)), F.when(has(legacy), F.lit(old))), F.lit(""))


def grams(x: Column, k: int) -> Column:
    """Distinct runs of k characters; none for shorter texts."""
    n = F.length(x)
    return F.when(n >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def shares_run(a: Column, b: Column, k: int) -> Column:
    """Whether the longest common substring has k characters or more."""
    return F.arrays_overlap(grams(a, k), grams(b, k))


def simple_address(x: Column, compat: bool = True) -> Column:
    """Through the last token that is numbers joined by hyphens; whole if there is none."""
    token = F.split(F.trim(_odd_space(nfkc(F.coalesce(x, F.lit(""))), compat)), " ")
    at = F.array_max(F.transform(token, lambda t, i: F.when(t.rlike("^[0-9]+(-[0-9]+)*$"), i + 1)))
    return F.when(at.isNull(), F.array_join(token, " ")).otherwise(F.array_join(F.slice(token, 1, F.coalesce(at, F.lit(1))), " "))


def prefecture(x: Column) -> Column:
    """The first prefecture, in list order, that the address contains."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, PREFECTURES)), lambda p: F.contains(x, p)), F.lit(1))


def geocode_queries(name: Column, address: Column, compat: bool = True) -> Column:
    """P25: candidates in order, each once by its light key, blank ones left out. P2 of constants stays native."""
    short = simple_address(address, compat)
    every = F.filter(F.array(short, F.trim(F.concat_ws(" ", F.coalesce(name, F.lit("")), short)), F.coalesce(address, F.lit("")), F.coalesce(name, F.lit(""))), lambda q: F.trim(q) != "")
    key = lambda q: F.lower(F.translate(q, " 　", ""))
    return F.aggregate(every, F.array().cast("array<string>"), lambda a, q: F.when(F.exists(a, lambda o: key(o) == key(q)), a).otherwise(F.concat(a, F.array(q))))


def kanji(n: Column) -> Column:
    """0-99 in kanji, other numbers in figures."""
    digit = lambda d: F.substring(F.lit(KANJI_DIGITS), d + 1, F.lit(1))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    small = F.concat(F.when(tens == 0, F.lit("")).when(tens == 1, F.lit("十")).otherwise(F.concat(digit(tens), F.lit("十"))), F.when((ones == 0) & (tens > 0), F.lit("")).otherwise(digit(ones)))
    return F.when(n.between(0, 99), small).otherwise(n.cast("string"))


def address_numbers(x: Column) -> Column:
    """The first two ASCII integers of the raw address."""
    found = F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1))
    return F.struct(F.try_element_at(found, F.lit(1)).try_cast("bigint").alias("first"), F.try_element_at(found, F.lit(2)).try_cast("bigint").alias("second"))


def district_address(x: Column) -> Column:
    """No blanks, N丁目 in kanji; without 丁目 the first number (and a hyphen after it) becomes N丁目."""
    a = geo_key(x)
    n = F.coalesce(F.nullif(F.regexp_extract(a, r"([0-9]+)丁目", 1), F.lit("")), F.when(~F.contains(a, F.lit("丁目")), F.nullif(F.regexp_extract(a, r"([0-9]+)", 1), F.lit(""))))
    word = F.concat(kanji(n.try_cast("int")), F.lit("丁目"))
    pattern = F.when(F.contains(a, F.lit("丁目")), F.concat(n, F.lit("丁目"))).otherwise(F.concat(n, F.lit("-?")))
    first = F.regexp_extract(a, r"^(.*?)[0-9]", 1)
    rest = F.regexp_replace(F.substring(a, F.length(first) + 1, F.length(a)), F.concat(F.lit("^"), pattern), word)
    return F.when(n.isNull(), a).when(F.contains(a, F.lit("丁目")), F.replace(a, F.concat(n, F.lit("丁目")), word)).otherwise(F.concat(first, rest))


def search_query(name: Column, address: Column, place: str = "東京都") -> Column:
    """The name, with the place if the address has it."""
    return F.when(F.contains(F.coalesce(address, F.lit("")), F.lit(place)), F.concat(name, F.lit(f" {place}"))).otherwise(name)


def joined_text(*parts: Column) -> Column:
    """Parts that aren't blank, joined by a blank."""
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def sub_genres(x: Column) -> Column:
    """Names in a JSON value that is an object, a text, or an array of both; none for others."""
    j = F.trim(F.coalesce(x, F.lit("")))
    name = lambda v: F.when(F.trim(v).startswith("{"), F.get_json_object(v, "$.name")).otherwise(v)
    many = F.transform(F.coalesce(F.from_json(j, "array<string>"), F.array().cast("array<string>")), name)
    found = F.when(j.startswith("["), many).otherwise(F.array(name(j)))
    return F.filter(found, lambda v: F.coalesce(v, F.lit("")) != "")
