"""Scoring, classification, budgets as bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import needles

# Weights of genres and words, in order.
GENRE_WEIGHTS = [("焼肉", 35), ("ホルモン", 32), ("ステーキ", 30), ("鉄板焼", 28), ("シュラスコ", 30), ("ジンギスカン", 28), ("肉バル", 25), ("ローストビーフ", 25), ("しゃぶしゃぶ", 22), ("すき焼き", 22), ("バーベキュー", 20), ("焼き鳥", 26), ("焼きとん", 25), ("鶏料理", 24), ("牛タン", 24), ("もつ鍋", 22), ("水炊き", 22), ("ラム", 24), ("ジビエ", 24)]
WORD_WEIGHTS = [("食べ放題", 12), ("肉盛り", 15), ("塊肉", 18), ("グリル", 10), ("熟成肉", 14), ("BBQ", 12), ("焼き鳥", 30), ("焼きとん", 26), ("串焼", 20), ("牛タン", 24), ("鶏料理", 22), ("水炊き", 22), ("もつ鍋", 22), ("しゃぶしゃぶ", 18), ("すき焼き", 18), ("サムギョプサル", 24), ("韓国焼肉", 22), ("シュラスコ", 26), ("アメリカンBBQ", 22), ("テキサスBBQ", 22), ("ポークリブ", 20), ("ラムチョップ", 22), ("羊肉串", 20), ("タンドリーチキン", 18), ("シークカバブ", 18)]
# Rank thresholds, score limits, genre rules in order of priority, exclusions.
RANKS, TOP = [("S", 80), ("A", 60), ("B", 45)], 100.0
PRIMARY = [("焼肉", ["焼肉", "yakiniku"]), ("ステーキ", ["ステーキ", "steak"]), ("シュラスコ", ["シュラスコ", "churrasco", "rc041103"]), ("もつ焼き", ["もつ焼", "ホルモン", "rc010604"]), ("焼き鳥", ["焼き鳥", "焼鳥", "yakitori"]), ("しゃぶしゃぶ", ["しゃぶしゃぶ", "shabushabu", "しゃぶ"])]
SECONDARY = [("韓国", ["韓国", "コリア"]), ("中華", ["中華", "中国"])]
TEXT_RULES = [("シュラスコ", ["シュラスコ", "churrasco", "バーベキュー"]), ("韓国", ["韓国", "コリアン", "サムギョプサル", "チゲ", "キムチ", "プルコギ", "タッカルビ"])]
OTHER, EXCLUDED = "その他", ["お好み焼", "もんじゃ"]
# The 13 classes that are shown, but その他. Their words are our choice where no case is pinned.
DISPLAY = {
    "焼肉": ["焼肉", "焼き肉", "yakiniku"], "ホルモン": ["ホルモン"], "ステーキ": ["ステーキ", "steak"], "焼き鳥": ["焼き鳥", "焼鳥", "やきとり", "yakitori"], "もつ焼き": ["もつ焼", "やきとん", "焼きとん"],
    "しゃぶしゃぶ": ["しゃぶしゃぶ", "しゃぶ", "shabu"], "すき焼き": ["すき焼", "すきやき", "sukiyaki"], "韓国": ["韓国", "コリア", "サムギョプサル"], "シュラスコ": ["シュラスコ", "churrasco"],
    "ジンギスカン": ["ジンギスカン", "ラム", "羊肉"], "肉バル": ["肉バル"], "ハンバーグ": ["ハンバーグ"],
}
#: Words of a name count before 焼肉, which many names say besides; in a stored genre 焼肉 leads.
NAME_TOKENS = [*((k, v) for k, v in DISPLAY.items() if k != "焼肉"), ("焼肉", DISPLAY["焼肉"])]
GENRE_TOKENS = [*DISPLAY.items()]
#: Words that hold a token but mean something else.
BLOCKED = ["フォーラム", "モーラム", "コラム", "プログラム", "グラム"]


def weighted(weights: list[tuple[str, float]], has) -> Column:
    """The sum of the weights whose word ``has`` finds, in list order."""
    total = F.lit(0.0)
    for word, w in weights:
        total = total + F.when(has(word), F.lit(float(w))).otherwise(0.0)
    return total


def score(genres: Column, text: Column, rating: Column, reviews: Column, genre_weights=GENRE_WEIGHTS, word_weights=WORD_WEIGHTS) -> Column:
    """genres' and words' weights, ratings over 3 and reviews up to 500, at most 100."""
    own = F.coalesce(genres, F.array().cast("array<string>"))
    total = weighted(genre_weights, lambda k: F.exists(own, lambda g: F.contains(g, F.lit(k)))) + weighted(word_weights, lambda k: F.contains(F.coalesce(text, F.lit("")), F.lit(k)))
    total = total + F.when(F.coalesce(rating, F.lit(0.0)) != 0, (rating - 3) * 8).otherwise(0.0) + F.when(F.coalesce(reviews, F.lit(0)) != 0, F.least(reviews, F.lit(500)) * 0.05).otherwise(0.0)
    return F.least(total, F.lit(TOP))


def rank(points: Column) -> Column:
    """E12."""
    out = F.when(points >= RANKS[0][1], RANKS[0][0])
    for name, least in RANKS[1:]:
        out = out.when(points >= least, name)
    return out.otherwise("C")


def first_rule(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule of which the text contains a word, else null."""
    out = F.lit(None).cast("string")
    for name, words in reversed(rules):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(text, F.lit(w))
        out = F.when(found, name).otherwise(out)
    return out


def stored_genre(name: Column, genre: Column, primary=PRIMARY, secondary=SECONDARY, other=OTHER) -> Column:
    """E5: by name, then genre, then name for the second rules. Texts are in NFKC and lower case."""
    n, g = F.coalesce(name, F.lit("")), F.coalesce(genre, F.lit(""))
    return F.coalesce(first_rule(n, primary), first_rule(g, primary), first_rule(n, secondary), F.lit(other))


def display_genre(name: Column, genre: Column) -> Column:
    """One of 13 classes: the name's by its tokens, else the stored genre's, else その他. Texts are in NFKC and lower case."""
    return F.coalesce(needles.token_class(name, NAME_TOKENS, BLOCKED), needles.token_class(genre, GENRE_TOKENS, BLOCKED), F.lit(OTHER))


def notes(text: Column, genres: Column, label: str = "主ジャンル: ") -> Column:
    """The text, or the first two genres."""
    return F.coalesce(F.nullif(text, F.lit("")), F.when(F.size(genres) > 0, F.concat(F.lit(label), F.array_join(F.slice(genres, 1, 2), ", "))))


def band(price: Column) -> Column:
    """F8."""
    return F.when(price.isNull(), "unknown").when(price <= 3000, "p3k").when(price <= 5000, "p5k").when(price <= 10000, "p10k").otherwise("p10kplus")


def excluded(*texts: Column, words=EXCLUDED) -> Column:
    """F2."""
    out = F.lit(False)
    for t in texts:
        for w in words:
            out = out | F.contains(F.coalesce(t, F.lit("")), F.lit(w))
    return out


def of_rank(rows: DataFrame, ranks: list[str] | None, column: str = "carnivore_rank") -> DataFrame:
    """rows of the ranks; none given, all."""
    return rows.where(F.col(column).isin(ranks)) if ranks else rows
