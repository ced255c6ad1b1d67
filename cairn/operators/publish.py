"""The published set: preparation, full merge, checks and metadata.

Rows that can't be used are data, not exceptions: every step gives a table of problems beside its rows,
and only a sink raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.functions import text as X
from cairn.operators import match, snapshot

# Columns of a published set in order; those an overlay leaves to the base; names, hosts, limits.
BASE_COLUMNS = [
    "name", "address", "lat", "lng", "carnivore_rank", "carnivore_score", "genre", "rating", "review_count", "sources", "url", "notes",
    "lunch_budget_min", "lunch_budget_max", "dinner_budget_min", "dinner_budget_max", "budget_lunch", "budget_dinner", "avg_dinner_budget",
]
LINEAGE_COLUMNS = ["hotpepper_url", "legacy_id", "data_status", "last_verified_at"]
OUTPUT_COLUMNS = BASE_COLUMNS + LINEAGE_COLUMNS
FROM_BASE = ["sources", "url", "lunch_budget_min", "lunch_budget_max", "dinner_budget_min", "dinner_budget_max"]
BUDGETS = ["budget_lunch", "budget_dinner", "avg_dinner_budget"]
REQUIRED_COLUMNS = ["name", "lat", "lng", "sources", "url", "hotpepper_url", "legacy_id", "data_status", "last_verified_at", "genre", "address"]
LISTED, OLD, MARKER = "hotpepper", "legacy_local", "tabelog"
HOSTS = ["hotpepper.jp", "www.hotpepper.jp"]
FORBIDDEN = "(?i)tabelog|食べログ"
CURRENT, UNVERIFIED = "current", "legacy_unverified"
SCOPE = "hotpepper,legacy_local"
# Secrets, and texts that a public page must not have.
SECRETS = {"Google API key": r"AIza[0-9A-Za-z_-]{30,}", "GitHub token": r"(?:gh[opsu]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{20,})", "OpenAI API key": r"sk-[0-9A-Za-z_-]{20,}"}
FORBIDDEN_TEXTS = {
    "make-a-big-promise": "branch", "buymeacoffee.com/yourname": "support link", "fundingchoicesmessages.google.com": "consent script", "pagead2.googlesyndication.com": "advert script",
    "googletagmanager.com/gtag/js": "analytics script", "assets/new_pins": "image", "assets/pins": "image", "tabelog.com": "validation service",
}
MINIMUM_ROWS, MINIMUM_LEGACY, MAXIMUM_BYTES, FRESH_DAYS, RADIUS_M = 8444, 4847, 5 << 20, 45, 50.0

_ISO = r"^\d{4}-\d{2}-\d{2}$"


def blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def metadata_date(metadata: dict[str, str], key: str = "generated_at_utc") -> str:
    """An ISO date, or the date of an ISO time; ValueError for others."""
    raw = metadata.get(key, "").strip()
    return raw if re.fullmatch(_ISO, raw) else datetime.fromisoformat(raw.replace("Z", "+00:00")).date().isoformat()


def check_options(radius_m: float, minimum: int = 0, generated_at: str | None = None, output: str = "", current: str | None = None) -> list[str]:
    """What is wrong with the options of a merge."""
    wrong = []
    if not radius_m > 0:
        wrong.append("the radius must be positive")
    if minimum < 0:
        wrong.append("the minimum must not be negative")
    if current is not None and output == current:
        wrong.append("output and current input must differ")
    if generated_at is not None:
        try:
            if datetime.fromisoformat(generated_at.replace("Z", "+00:00")).tzinfo is None:
                wrong.append("generated_at needs a time zone")
        except ValueError:
            wrong.append("generated_at is no ISO time")
    return wrong


def _outputs(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``OUTPUT_COLUMNS`` (and ``more``) as trimmed strings, missing ones and nulls empty."""
    own = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in rows.columns else F.lit("")
    return rows.select("row", *(own(c).alias(c) for c in (*OUTPUT_COLUMNS, *more)))


def _listing(url: Column) -> Column:
    """The URL if it is a listing's, else empty."""
    return F.when(X.listing_id(url, HOSTS).isNotNull(), F.trim(url)).otherwise("")


def _with_problems(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return rows.withColumn("problems", F.array_compact(F.array(*(F.when(wrong, F.lit(name)) for name, wrong in rules.items()))))


def prepare_current(rows: DataFrame, day: str) -> DataFrame:
    """Rows of a fresh scan as output rows, with ``row`` as it was, ``id`` and ``problems`` (E3.url, W2).

    A listing URL is required; an old id is dropped; status and date are stamped.
    """
    listing = F.coalesce(F.nullif(F.col("hotpepper_url"), F.lit("")), F.col("url"))
    done = _outputs(rows).withColumn("hotpepper_url", _listing(listing)).withColumn("url", F.col("hotpepper_url"))
    done = done.withColumns({"legacy_id": F.lit(""), "sources": F.lit(LISTED), "data_status": F.lit(CURRENT), "last_verified_at": F.lit(day), "id": X.listing_id(F.col("hotpepper_url"), HOSTS)})
    return _with_problems(done, {"E3.url": F.col("id").isNull(), "W2": ~N.valid_point(F.col("lat"), F.col("lng"))})


def prepare_legacy(rows: DataFrame, day: str) -> DataFrame:
    """Rows of the published set as output rows, with ``row``, ``id``, ``migrated`` and ``problems``.

    A row that shows the old marker and has no id gets one made of its public attributes. Problems:
    E3.sources (unknown source), E3.legacy_id (malformed, or missing on a row of that source), E3.attributes
    (no name or address to make an id of), E3.url (listed without a valid URL), E3.lineage (no source left), W2.
    """
    done = _outputs(rows, ("tabelog_url", "tabelog_id"))
    declared = X.tokens(F.col("sources"))
    marked = F.array_contains(declared, MARKER) | F.contains(F.lower("url"), F.lit(MARKER)) | F.contains(F.lower("tabelog_url"), F.lit(MARKER)) | ~blank("tabelog_id")
    own = X.valid_legacy_id(F.col("legacy_id"))
    migrated = (own == "") & marked
    facts = done.withColumns({
        "hotpepper_url": _listing(F.coalesce(F.nullif(F.col("hotpepper_url"), F.lit("")), F.col("url"))),
        "migrated": migrated,
        "unknown": F.size(F.array_except(declared, F.array(*map(F.lit, (LISTED, OLD, MARKER))))) > 0,
        "malformed": ~blank("legacy_id") & (own == "") | (own == "") & ~marked & F.array_contains(declared, OLD),
        "listed": F.array_contains(declared, LISTED),
        "legacy_id": F.when(migrated, X.legacy_id(F.col("name"), F.col("address"), F.col("lat"), F.col("lng"), F.col("genre"))).otherwise(own),
    })
    done = facts.withColumns({
        "sources": F.coalesce(X.lineage(F.col("hotpepper_url"), F.col("legacy_id"), LISTED, OLD), F.lit("")),
        "url": F.col("hotpepper_url"),
        "data_status": F.lit(UNVERIFIED),
        "last_verified_at": F.when(F.col("last_verified_at").rlike(_ISO), F.col("last_verified_at")).otherwise(F.lit(day)),
        "id": X.listing_id(F.col("hotpepper_url"), HOSTS),
    })
    rules = {
        "E3.sources": F.col("unknown"),
        "E3.legacy_id": F.col("malformed"),
        "E3.attributes": F.col("migrated") & (blank("name") | blank("address")),
        "E3.url": F.col("listed") & (F.col("hotpepper_url") == ""),
        "E3.lineage": F.col("sources") == "",
        "W2": ~N.valid_point(F.col("lat"), F.col("lng")),
    }
    return _with_problems(done, rules).drop("unknown", "malformed", "listed", "tabelog_url", "tabelog_id")


def later_repeats(rows: DataFrame, column: str, rule: str) -> DataFrame:
    """(row, rule) of each row whose value an earlier row has; blank values don't count.

    Merged, as are the joins of ``merge``: files of like rows are small, so sizes guessed from them make either side a broadcast.
    """
    own = rows.where(~blank(column)).select("row", column)
    first = own.groupBy(column).agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select(column, "first")
    return own.join(first.hint("merge"), column).where("row > first").select("row", F.lit(rule).alias("rule"))


def input_problems(rows: DataFrame, label: str) -> DataFrame:
    """(side, row, rule) of prepared rows."""
    own = rows.select("row", F.explode("problems").alias("rule"))
    repeats = later_repeats(rows, "id", "W10.id").unionByName(later_repeats(rows, "legacy_id", "W10.legacy_id"))
    return own.unionByName(repeats).select(F.lit(label).alias("side"), "row", "rule")


def prefer_overlay(base: Column, preferred: Column) -> Column:
    """A row of ``OUTPUT_COLUMNS`` from two: the preferred one's values unless blank; the base's lineage and ranges stay."""
    value = {c: base[c] if c in FROM_BASE else F.when(blank(preferred[c]), base[c]).otherwise(F.trim(preferred[c])) for c in BASE_COLUMNS}
    url, old = (F.when(blank(preferred[c]), base[c]).otherwise(preferred[c]) for c in ("hotpepper_url", "legacy_id"))
    value |= {"hotpepper_url": url, "legacy_id": old, "url": url, "sources": F.coalesce(X.lineage(url, old, LISTED, OLD), F.lit(""))}
    value["data_status"] = F.when((preferred["data_status"] == CURRENT) | (base["data_status"] == CURRENT), CURRENT).otherwise(UNVERIFIED)
    dates = [F.when(s["last_verified_at"].rlike(_ISO), s["last_verified_at"]) for s in (base, preferred)]
    value["last_verified_at"] = F.coalesce(F.greatest(*dates), F.lit(""))
    return F.struct(*(value[c].alias(c) for c in OUTPUT_COLUMNS))


@dataclass(frozen=True)
class Merged:
    """Rows in order with ``how``, what was wrong with the inputs, and one row of counters."""

    rows: DataFrame
    problems: DataFrame
    stats: DataFrame


def merge(current: DataFrame, legacy: DataFrame, current_day: str, legacy_day: str, radius_m: float = RADIUS_M) -> Merged:
    """The full merge of a fresh scan into the published set. Sides have a column ``row``.

    Rows with problems, and later rows of an id that an earlier one has, are in ``problems`` and not merged.
    Rows of one listing id meet; then rows whose id is gone meet a fresh row of equal name within the radius,
    one to one; then rows without an old id meet rows that have nothing else likewise. Candidates are counted, and only
    pairs of rows that have one are made, so names that many rows have cost no more than their rows.
    """
    if wrong := check_options(radius_m):
        raise ValueError("; ".join(wrong))
    # Written with the keys of names, as they are read several times: keys take a pass through Python.
    keyed = lambda d: d.withColumn("key", F.nullif(X.strong_key(F.col("name")), F.lit("")))
    sides = {k: match.settled(keyed(d)) for k, d in (("current", prepare_current(current, current_day)), ("legacy", prepare_legacy(legacy, legacy_day)))}
    problems = match.settled(input_problems(sides["current"], "current").unionByName(input_problems(sides["legacy"], "legacy")))
    usable = {k: d.join(problems.where(F.col("side") == k).select("row").distinct().hint("merge"), "row", "left_anti") for k, d in sides.items()}
    packed = lambda d: d.select("row", "id", "key", F.struct(*OUTPUT_COLUMNS).alias("r"))
    fresh, known = packed(usable["current"]), packed(usable["legacy"])
    point = lambda d, n: d.select(F.col(n).alias("id"), "key", F.col("r.lat").cast("double").alias("lat"), F.col("r.lng").cast("double").alias("lng"))

    own = lambda d, p: d.select(F.col("row").alias(f"{p}_row"), F.col("id").alias(f"{p}_id"), F.col("key").alias(f"{p}_key"), F.col("r").alias(p))
    met = match.settled(own(fresh, "c").join(own(known.where("id is not null"), "l"), F.col("c_id") == F.col("l_id"), "full_outer"))
    exact = met.where("c_row is not null and l_row is not null")
    side = lambda d, p: d.select(f"{p}_row", F.col(f"{p}_key").alias("key"), F.col(p).alias("r"))
    new, gone = side(met.where("l_row is null"), "c"), side(met.where("c_row is null"), "l")
    near, reissues = match.settled_matches(point(gone, "l_row"), point(new, "c_row"), radius_m)
    again = near.select(F.col("l_id").alias("l_row"), F.col("r_id").alias("c_row"))
    part = lambda d, p: d.select(f"{p}_row", F.col("key").alias(f"{p}_key"), F.col("r").alias(p))
    reissued = again.join(part(new, "c").hint("merge"), "c_row").join(part(gone, "l").hint("merge"), "l_row")
    fused_key = F.when(blank("c.name"), F.col("l_key")).otherwise(F.col("c_key"))
    fused = lambda d, how: d.select(fused_key.alias("key"), prefer_overlay(F.col("l"), F.col("c")).alias("r"), F.lit(how).alias("how"))
    alone = lambda d, how: d.select("key", "r", F.lit(how).alias("how"))
    listed = fused(exact, "exact").unionByName(fused(reissued, "reissued")).unionByName(alone(new.join(again.hint("merge"), "c_row", "left_anti"), "new")).unionByName(alone(gone.join(again.hint("merge"), "l_row", "left_anti"), "retained"))
    # A listing id is unique among listed rows.
    listed = match.settled(listed.withColumn("id", X.listing_id(F.col("r.hotpepper_url"), HOSTS)))
    only = known.where("id is null").select(F.col("r.legacy_id").alias("old"), "key", "r")
    met_old, crosses = match.settled_matches(point(listed.where(blank("r.legacy_id")), "id"), point(only, "old"), radius_m)
    taken = met_old.select(F.col("l_id").alias("id"), F.col("r_id").alias("old"))
    # Old rows join their ids first: most listed rows have none, and would lie in one task by it.
    both = listed.join(taken.join(only.select("old", F.col("r").alias("o")).hint("merge"), "old").hint("merge"), "id", "left")
    joined = both.select(F.when(F.col("o").isNull(), F.col("r")).otherwise(prefer_overlay(F.col("o"), F.col("r"))).alias("r"), F.when(F.col("o").isNull(), F.col("how")).otherwise("cross").alias("how"), F.col("how").alias("first_how"))
    rest = only.join(taken.hint("merge"), "old", "left_anti").select("r", F.lit("legacy_only").alias("how"), F.lit("legacy_only").alias("first_how"))
    rows = joined.unionByName(rest).select("r.*", "how", "first_how")
    clean = {c: N.public_budget(F.col(c)) for c in BUDGETS}
    spoiled = sum((F.when(~blank(c) & (v == ""), 1).otherwise(0) for c, v in clean.items()), F.lit(0))
    order = {f"__{k}": c for k, c in enumerate(_order())}  # written too: a sort takes them twice
    rows = match.settled(rows.withColumn("sanitized", spoiled).withColumns(clean | order))
    stats = rows.agg(*(F.count_if(F.col("first_how") == h).alias(n) for h, n in (("exact", "hotpepper_id_updates"), ("reissued", "hotpepper_reissued_matches"))), F.count_if(F.col("how") == "cross").alias("cross_source_matches"), F.coalesce(F.sum("sanitized"), F.lit(0)).alias("sanitized_budget_values"), F.count("*").alias("output_rows"))
    for more in (
        current.agg(F.count("*").alias("current_input")),
        legacy.agg(F.count("*").alias("legacy_input")),
        usable["legacy"].agg(F.count_if("migrated").alias("migrated_legacy_ids")),
        reissues.select(F.col("ambiguous").alias("ambiguous_reissue_candidates")),
        crosses.select(F.col("ambiguous").alias("ambiguous_cross_source_candidates")),
    ):
        stats = stats.crossJoin(more)  # single rows
    return Merged(rows.orderBy(*order).drop("sanitized", "first_how", *order), problems, stats)


def _order() -> list[Column]:
    return [X.strong_key(F.col("name")), X.strong_key(F.col("address")), F.coalesce(X.listing_id(F.col("hotpepper_url"), HOSTS), F.lit("")), X.valid_legacy_id(F.col("legacy_id"))]


def in_order(rows: DataFrame) -> DataFrame:
    """O1: by strong keys of name and address, then ids."""
    return rows.orderBy(*_order())


def merged_problems(rows: DataFrame) -> DataFrame:
    """(row, rule) of what must not be in a merged set. ``rows``: OUTPUT_COLUMNS and ``row``."""
    forbidden = F.lit(False)
    for c in OUTPUT_COLUMNS:
        forbidden = forbidden | F.coalesce(F.col(c), F.lit("")).rlike(FORBIDDEN)
    identifier = X.listing_id(F.col("hotpepper_url"), HOSTS)
    rules = {
        "W1": forbidden,
        "W2": ~N.valid_point(F.col("lat"), F.col("lng")),
        "W3": F.coalesce(F.col("sources"), F.lit("")) != F.coalesce(X.lineage(F.col("hotpepper_url"), F.col("legacy_id"), LISTED, OLD), F.lit("")),
        "W4": F.coalesce(F.col("url"), F.lit("")) != F.coalesce(F.col("hotpepper_url"), F.lit("")),
        "W7": ~F.coalesce(F.col("data_status").isin(CURRENT, UNVERIFIED), F.lit(False)),
        "W8": (F.col("data_status") == CURRENT) & identifier.isNull(),
        "W9": ~F.coalesce(F.col("last_verified_at"), F.lit("")).rlike(_ISO),
    }
    own = rows.withColumns({"__id": identifier, "__old": X.valid_legacy_id(F.col("legacy_id"))})
    return snapshot.violations(rows, rules, "row").unionByName(later_repeats(own, "__id", "W5")).unionByName(later_repeats(own, "__old", "W6"))


def count_problem(merged: int, legacy: int, minimum: int = MINIMUM_ROWS) -> list[str]:
    """W11."""
    floor = max(minimum, legacy)
    return [f"{merged} rows are fewer than {floor}"] if merged < floor else []


def output_metadata(rows: int, generated_at: str, current_day: str, legacy_day: str, radius_m: float = RADIUS_M) -> dict[str, str]:
    """K3: the six lines above a published set, in order."""
    return {"generated_at_utc": generated_at, "source_scope": SCOPE, "current_snapshot_at": current_day, "legacy_snapshot_at": legacy_day, "match_radius_meters": f"{radius_m:g}", "total_records": str(rows)}


def row_problems(rows: DataFrame, as_of: Column) -> DataFrame:
    """(row, rule) of a published set. ``rows``: OUTPUT_COLUMNS and ``row``."""
    named = rows.withColumn("listing_url", F.col("hotpepper_url"))
    own = rows.withColumns({"__id": F.when(F.array_contains(X.tokens(F.col("sources")), LISTED), X.listing_id(F.col("hotpepper_url"), HOSTS)), "__old": F.when(F.array_contains(X.tokens(F.col("sources")), OLD), X.valid_legacy_id(F.col("legacy_id")))})
    return snapshot.violations(named, snapshot.public_rules(as_of), "row").unionByName(later_repeats(own, "__id", "V8")).unionByName(later_repeats(own, "__old", "V10.repeated"))


def missing_columns(rows: DataFrame) -> list[str]:
    """V1."""
    return [c for c in REQUIRED_COLUMNS if c not in rows.columns]


def dataset_problems(rows: DataFrame, metadata: dict[str, str], now: datetime, size_bytes: int = 0, minimum: int = MINIMUM_ROWS, minimum_legacy: int = MINIMUM_LEGACY) -> DataFrame:
    """(rule, level, broken) of a whole set, each rule once; V24.age is a warning. One aggregate over the rows."""
    today = now.astimezone(timezone.utc).date()
    own = X.tokens(F.col("sources"))
    whole = F.concat_ws("\n", *(F.col(c) for c in rows.columns if c in OUTPUT_COLUMNS))
    status = F.lower(F.trim(F.coalesce(F.col("data_status"), F.lit(""))))
    one = rows.agg(
        F.count("*").alias("n"),
        F.countDistinct(F.when(F.array_contains(own, OLD), F.nullif(X.valid_legacy_id(F.col("legacy_id")), F.lit("")))).alias("old"),
        *(F.count_if(F.array_contains(own, s)).alias(s) for s in (LISTED, OLD)),
        *(F.count_if(status == s).alias(s) for s in (CURRENT, UNVERIFIED)),
        F.count_if(whole.rlike(FORBIDDEN)).alias("forbidden"),
    )

    def past(value: str) -> bool:
        try:
            return bool(re.fullmatch(_ISO, value)) and date.fromisoformat(value) <= today
        except ValueError:
            return False

    total, made = metadata.get("total_records", ""), metadata.get("generated_at_utc", "")
    try:
        at = datetime.fromisoformat(made.replace("Z", "+00:00"))
        age = (now - (at if at.tzinfo else at.replace(tzinfo=timezone.utc))).days
    except ValueError:
        age = None
    rules = [
        ("V18", "error", F.col("n") != int(total) if total.isdigit() else F.lit(True)),
        ("V19", "error", F.col("n") < minimum),
        ("V20", "error", F.col("old") < minimum_legacy),
        *((f"V21.{s}", "error", F.col(s) == 0) for s in (LISTED, OLD, CURRENT, UNVERIFIED)),
        ("V22", "error", F.lit(metadata.get("source_scope") != SCOPE)),
        *((f"V23.{k}", "error", F.lit(not past(metadata.get(k, "")))) for k in ("current_snapshot_at", "legacy_snapshot_at")),
        ("V24", "error", F.lit(age is None)),
        ("V24.age", "warning", F.lit(age is not None and age > FRESH_DAYS)),
        ("V25.size", "error", F.lit(size_bytes > MAXIMUM_BYTES)),
        ("V25.token", "error", F.col("forbidden") > 0),
    ]
    return one.select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(level).alias("level"), broken.alias("broken")) for r, level, broken in rules))))
