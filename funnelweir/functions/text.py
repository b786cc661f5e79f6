"""Item, review and model-reply texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelweir.functions.scalars import clip

# fixed values: review texts written by the shop system, and printed nulls
SYSTEM_REVIEWS = ["此用户没有填写评价内容", "该用户没有填写评价内容", "默认好评", "无评价内容", "nan", "None"]
# fixed values: review texts without content
STOCK_REVIEWS = [
    "none",
    "na",
    "n/a",
    "good",
    "great",
    "ok",
    "okay",
    "nice",
    "love it",
    "works great",
    "five stars",
    "five star",
    "as expected",
]
# fixed value: category label in two languages
CATEGORY_PATTERN = r"(?:Category|类目)[:：]\s*([^|]+)"

CONSTRUCT_CODES = [
    "T_con_mkt",
    "T_int_vis",
    "T_int_fac",
    "a_pri",
    "a_gft",
    "a_sub",
    "a_urg",
    "a_spec",
    "a_str",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def item_text(brand, categories: Sequence, name) -> Column:
    """``Brand: .. | Category: a-b-c | Product name: ..`` with Unknown for missing parts."""
    part = lambda c: F.coalesce(_col(c).cast("string"), F.lit("Unknown"))
    return F.concat(
        F.lit("Brand: "),
        part(brand),
        F.lit(" | Category: "),
        F.concat_ws("-", *[part(c) for c in categories]),
        F.lit(" | Product name: "),
        part(name),
    )


def listing_text(store, category, title, features, max_features: int = 300) -> Column:
    """Text of a listing; the joined feature list keeps its first ``max_features`` characters."""
    named = lambda c, default: F.trim(F.coalesce(F.when(_col(c) != "", _col(c)), F.lit(default)))
    joined = F.substring(F.array_join(_col(features), " "), 1, max_features)
    feature_text = F.when(F.size(_col(features)) > 0, joined).otherwise(F.lit("None"))
    return F.concat(
        F.lit("Brand: "),
        named(store, "Unknown brand"),
        F.lit(" | Category: "),
        named(category, "Unknown category"),
        F.lit(" | Title: "),
        named(title, ""),
        F.lit(" | Product features: "),
        feature_text,
    )


def category_table(items: DataFrame, out: str = "category") -> DataFrame:
    """One category per item from the first source column present.

    From text: the labelled part in either language; when no text of the table
    has a label, the second ``|`` part.
    """
    if "category" in items.columns:
        category = F.col("category")
    elif "cat_name" in items.columns:
        category = F.col("cat_name")
    elif "text_W" in items.columns:
        text = F.coalesce(F.col("text_W"), F.lit(""))
        labelled = F.regexp_extract(text, CATEGORY_PATTERN, 1)
        second = F.try_element_at(F.split(text, r"\|", 3), F.lit(2))
        found = items.agg(F.max((labelled != "").cast("int")).alias("_any"))
        items = items.crossJoin(F.broadcast(found))
        category = F.when(F.col("_any") == 1, F.when(labelled != "", labelled)).otherwise(second)
    else:
        category = F.lit("Unknown")
    named = items.select("item_id", F.trim(F.coalesce(category, F.lit("Unknown"))).alias(out))
    return named.groupBy("item_id").agg(F.min(out).alias(out))


def is_valid_review_short(c) -> Column:
    """At least two characters and no system text."""
    cleaned = F.trim(_col(c).cast("string"))
    return F.coalesce(~cleaned.isin(SYSTEM_REVIEWS) & (F.length(cleaned) >= 2), F.lit(False))


def is_valid_review(c) -> Column:
    """At least ten characters and no stock phrase."""
    cleaned = F.trim(_col(c))
    return F.coalesce((F.length(cleaned) >= 10) & ~F.lower(cleaned).isin(STOCK_REVIEWS), F.lit(False))


def first_unique_texts(
    reviews: DataFrame,
    k: int = 5,
    item: str = "item_id",
    text: str = "review_text",
    order: str = "ingest_order",
    with_text: bool = True,
) -> DataFrame:
    """The first ``k`` distinct non-blank texts per item in stored order, one row each with ``rank``.

    ``with_text=False`` compares texts by digest and leaves them out, so no
    text is shuffled.
    """
    kept = reviews.filter(F.col(item).isNotNull() & (F.trim(F.col(text)) != ""))
    key = text if with_text else "_digest"
    if not with_text:
        kept = kept.withColumn("_digest", F.md5(F.col(text))).drop(text)
    # copies of one text collapse before the shuffle by item
    others = [c for c in kept.columns if c not in (item, key)]
    unique = kept.groupBy(item, key).agg(F.min_by(F.struct(*others), order).alias("_row"))
    shown = [item, text] if with_text else [item]
    flat = unique.select(*shown, *[F.col(f"_row.{c}").alias(c) for c in others])
    # row_number <= k is cut per task before the shuffle, so a hot item sends k rows per task
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(order)))
    return ranked.filter(F.col("rank") <= k)


def review_rollup(reviews: DataFrame, k: int = 5, max_chars: int = 300, out: str = "all_reviews") -> DataFrame:
    """First ``k`` distinct texts per item joined with `` | `` and cut to ``max_chars``."""
    first = first_unique_texts(reviews, k)
    pairs = F.array_sort(F.collect_list(F.struct("rank", "review_text")))
    texts = F.transform(pairs, lambda p: p["review_text"])
    return first.groupBy("item_id").agg(F.substring(F.array_join(texts, " | "), 1, max_chars).alias(out))


def prompt_input(items: DataFrame, rollup: DataFrame) -> DataFrame:
    """Item text and review block in one prompt text."""
    joined = items.select("item_id", "text_W").join(rollup, "item_id", "left")
    prompt = F.concat(
        F.lit("[Core specifications]\n"),
        F.col("text_W"),
        F.lit("\n\n[User feedback]\n"),
        F.coalesce(F.col("all_reviews"), F.lit("None available")),
    )
    return joined.select("item_id", prompt.alias("aggregated_text"))


_PART = "struct<score:string,weight:string>"
_REPLY = (
    f"atomic_marketing struct<a_pri:{_PART},a_gft:{_PART},a_sub:{_PART},a_urg:{_PART}>, "
    f"atomic_functional struct<a_spec:{_PART},a_str:{_PART},a_text_fact:{_PART}>"
)


def _first_number(c: Column) -> Column:
    plain = c.try_cast("double")
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"\d*\.?\d+", 0).try_cast("double")
    return F.coalesce(plain, found, F.lit(0.0))


def parse_weighted_replies(replies: DataFrame, item: str = "item_id", text: str = "response") -> DataFrame:
    """Scores per item from replies with score/weight pairs, averaged over the item's usable replies."""
    bare = F.trim(F.regexp_replace(F.col(text), "```json|```", ""))
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    parsed = replies.select(item, F.from_json(F.when(body != "", body), _REPLY).alias("_r")).filter(
        "_r IS NOT NULL AND (_r.atomic_marketing IS NOT NULL OR _r.atomic_functional IS NOT NULL)"
    )
    marketing = ["a_pri", "a_gft", "a_sub", "a_urg"]
    visual = ["a_spec", "a_str"]
    path = {**dict.fromkeys(marketing, "atomic_marketing"), **dict.fromkeys([*visual, "a_text_fact"], "atomic_functional")}
    score = {c: _first_number(F.col(f"_r.{p}.{c}.score")) / 10.0 for c, p in path.items()}
    weight = {c: _first_number(F.col(f"_r.{p}.{c}.weight")) for c, p in path.items()}

    def composite(codes):
        total = sum((weight[c] for c in codes), F.lit(0.0))
        weighted = sum((score[c] * weight[c] for c in codes), F.lit(0.0))
        return weighted / F.when(total > 0, total).otherwise(1.0)

    flat = parsed.select(
        item,
        composite(marketing).alias("T_con_mkt"),
        composite(visual).alias("T_int_vis"),
        score["a_text_fact"].alias("T_int_fac"),
        *[score[c].alias(f"atomic_{c}") for c in [*marketing, *visual]],
    )
    names = [c for c in flat.columns if c != item]
    return flat.groupBy(item).agg(*[F.round(F.avg(c), 4).alias(c) for c in names])


def parse_score_replies(df: DataFrame, text: str = "response", codes: Sequence[str] = CONSTRUCT_CODES) -> DataFrame:
    """Scores clipped to 0..10, notes on every repair and a validity flag, one output row per input row."""
    bare = F.trim(F.regexp_replace(F.trim(F.col(text)), r"(?i)^```(?:json)?|```$", ""))
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    outer = F.from_json(F.when(body != "", body), "map<string,string>")
    parsed = df.withColumn("_o", outer)
    inner_text = F.coalesce(F.try_element_at("_o", F.lit("scores")), F.try_element_at("_o", F.lit("mcre_scores")))
    scores = F.coalesce(F.from_json(inner_text, "map<string,string>"), F.col("_o"))
    parsed = parsed.withColumn("_s", scores)
    claimed = F.coalesce(F.lower(F.try_element_at("_o", F.lit("schema_valid"))) != "false", F.lit(True))
    notes, values, usable = [], [], claimed & F.col("_o").isNotNull()
    for code in codes:
        raw = F.try_element_at("_s", F.lit(code))
        number = raw.try_cast("double")
        missing = raw.isNull() | (raw == "")
        note = (
            F.when(missing, F.lit(f"missing_{code}"))
            .when(number.isNull(), F.lit(f"non_numeric_{code}"))
            .when((number < 0) | (number > 10), F.lit(f"clipped_{code}"))
        )
        notes.append(note)
        values.append(clip(number, 0.0, 10.0).alias(f"{code}_0_10"))
        usable = usable & number.isNotNull()
    listed = F.array_join(F.filter(F.array(*notes), lambda n: n.isNotNull()), ";")
    note = F.when(F.col("_o").isNull(), F.lit("json_parse_error")).otherwise(listed)
    keep = [c for c in df.columns if c != text]
    return parsed.select(*keep, usable.alias("schema_valid"), *values, note.alias("notes"))


def audit_prompt(row_columns: Sequence[str], rubric: str, text: Column, max_chars: int = 1500) -> Column:
    """Prompt text of one audit row; the excerpt keeps its first ``max_chars`` characters."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in row_columns]
    excerpt = F.concat(F.lit("Text excerpt: "), F.substring(F.coalesce(text, F.lit("")), 1, max_chars))
    return F.concat_ws("\n", F.lit(rubric), *lines, excerpt)
