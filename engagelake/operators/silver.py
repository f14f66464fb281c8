"""Bronze to Silver: typed, de-duplicated, exploded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engagelake.functions.casts import lenient_bool, lenient_int, lenient_long, pinned_flag, zero_if_null
from engagelake.functions.dates import DEFAULT_ZONE, local_time
from engagelake.functions.nested import decode_list, flatten
from engagelake.functions.text import text_length
from engagelake.schemas import COMMENT, SILVER_COMMENTS, first_present, present_columns, quoted

# Columns that never reach Silver, and the columns each cleaner types.
PROFILE_NOISE = [
    "businessAddress", "externalUrl", "externalUrlShimmed", "biography", "highlightReelCount", "url",
    "profilePicUrl", "profilePicUrlHD", "fbid",
]
POST_NOISE = ["hashtags", "mentions", "images", "childPosts", "taggedUsers", "coauthorProducers", "musicInfo"]
COMMENT_NOISE = [*POST_NOISE, "replies"]
PROFILE_COUNTERS = ["followersCount", "followsCount", "postsCount", "igtvVideoCount"]
PROFILE_FLAGS = ["verified", "private", "isBusinessAccount", "hasChannel", "joinedRecently"]
POST_COUNTERS = ["commentsCount", "likesCount", "videoPlayCount", "videoViewCount"]
MAX_COMMENT_LENGTH = 512


def keep_latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: the newest ``version``, nulls oldest, ties by row content; null keys form one group.

    Every partition keeps its first row per key before the shuffle, so a key with a third of all rows is reduced early.
    """
    rest = [c for c in df.columns if c not in keys]
    sortable = [c for c in rest if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    order = [quoted(version).desc_nulls_last(), *[quoted(c).desc_nulls_last() for c in sortable if c != version]]
    first = F.row_number().over(Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*order))
    return df.withColumn("__first", first).where(F.col("__first") == 1).drop("__first")


def clean_profiles(bronze: DataFrame) -> DataFrame:
    """Drop noise, type counters and flags, keep the newest row per id, fill the display name column."""
    df = bronze.drop(*PROFILE_NOISE)
    df = df.withColumns(
        {c: lenient_int(quoted(c), df.schema[c].dataType) for c in present_columns(df, PROFILE_COUNTERS)}
    )
    df = df.withColumns({c: lenient_bool(quoted(c)) for c in present_columns(df, PROFILE_FLAGS)})
    if {"id", "_ingested_at"} <= set(df.columns):
        df = keep_latest(df, ["id"], "_ingested_at")
    if "fullName" not in df.columns:
        source = first_present(df, ["username", "inputUrl"])
        df = df.withColumn("fullName", quoted(source) if source else F.lit(None).cast("string"))
    return df.withColumn("_source_layer", F.lit("bronze"))


def _clean_publications(bronze: DataFrame, kind: str, zone: str, dedupe_keys: list[str] | None) -> DataFrame:
    df = bronze.drop(*POST_NOISE)
    if dedupe_keys:
        df = keep_latest(df, dedupe_keys, "_ingested_at")
    if "timestamp" in df.columns:
        df = df.withColumn("data_hora", local_time(quoted("timestamp"), zone))
    df = df.withColumns(
        {c: lenient_long(quoted(c), df.schema[c].dataType) for c in present_columns(df, POST_COUNTERS)}
    )
    return df.withColumns({"Tipo": F.lit(kind), "_source_layer": F.lit("bronze")})


def clean_posts(bronze: DataFrame, zone: str = DEFAULT_ZONE, dedupe_keys: list[str] | None = None) -> DataFrame:
    """Feed posts. All runs are kept unless ``dedupe_keys`` asks for the newest row per key."""
    return _clean_publications(bronze, "FEED", zone, dedupe_keys)


def clean_reels(bronze: DataFrame, zone: str = DEFAULT_ZONE, dedupe_keys: list[str] | None = None) -> DataFrame:
    """Short videos, with the engagement total and the pinned flag."""
    df = _clean_publications(bronze, "REELS", zone, dedupe_keys)
    df = with_engagement_total(df)
    if "isPinned" in df.columns:
        df = df.withColumn("isPinned", pinned_flag(quoted("isPinned")))
    return df


def with_engagement_total(df: DataFrame) -> DataFrame:
    """Add comments + likes unless the table already has the total."""
    if "Total de Engajamento" in df.columns:
        return df
    parts = [zero_if_null(quoted(c)) for c in present_columns(df, ["commentsCount", "likesCount"])]
    total = sum(parts, F.lit(0)).cast("bigint")
    return df.withColumn("Total de Engajamento", total)


def explode_comments(
    reels: DataFrame,
    element: T.StructType = COMMENT,
    strict: bool = False,
    keep_empty: bool = False,
) -> DataFrame:
    """Reel columns and one struct column ``comment`` per nested comment.

    Accepts JSON text, a list of structs or one struct. Equal comments of one row all come out; callers drop equal rows.
    """
    kind = reels.schema["latestComments"].dataType
    source = quoted("latestComments")
    if isinstance(kind, T.StringType):
        listed = decode_list(source, element, strict)
    elif isinstance(kind, T.StructType):
        listed = F.when(source.isNotNull(), F.array(source))
    else:
        listed = source
    explode = F.explode_outer if keep_empty else F.explode
    others = [quoted(c) for c in reels.columns if c != "latestComments"]
    exploded = reels.select(*others, explode(listed).alias("comment"))
    return exploded if keep_empty else exploded.where(F.col("comment").isNotNull())


def clean_comments(
    reels: DataFrame,
    element: T.StructType = COMMENT,
    strict: bool = False,
    max_length: int = MAX_COMMENT_LENGTH,
) -> DataFrame:
    """Reels to comments in one pass: explode, measure, filter by length, drop equal rows."""
    spark = reels.sparkSession
    if "latestComments" not in reels.columns:
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in SILVER_COMMENTS]))
    exploded = explode_comments(reels, element, strict)
    fields = {f.name for f in exploded.schema["comment"].dataType}
    comment = F.col("comment")

    def field(name: str, kind: str) -> F.Column:
        return comment.getField(name).cast(kind) if name in fields else F.lit(None).cast(kind)

    text = field("text", "string") if "text" in fields else F.lit("")
    lineage = present_columns(exploded, ["_ingested_at", "_run_id"])
    owner = field("ownerUsername", "string")
    if "owner" in fields and "username" in exploded.schema["comment"].dataType["owner"].dataType.names:
        owner = F.coalesce(owner, comment.getField("owner").getField("username"))
    # Rows are equal only if every reel column is; the ones that are not kept take part as a digest.
    kept = {"id", "inputUrl", *lineage}
    other = [c for c in exploded.columns if c not in kept and c != "comment"]
    digest = F.sha2(F.to_json(F.struct(*[quoted(c) for c in other])), 256) if other else F.lit("")
    slim = exploded.select(
        quoted("id").cast("string").alias("id_reel"),
        (quoted("inputUrl") if "inputUrl" in exploded.columns else F.lit(None)).cast("string").alias("inputUrl"),
        *[quoted(c) for c in lineage],
        comment,
        digest.alias("__rest"),
    ).where(text_length(text) < max_length)
    return slim.dropDuplicates().select(
        "id_reel",
        field("id", "string").alias("id_comment"),
        text.alias("text"),
        text_length(text).alias("comprimento texto"),
        owner.alias("ownerUsername"),
        field("likesCount", "bigint").alias("likesCount"),
        field("repliesCount", "bigint").alias("repliesCount"),
        field("timestamp", "string").alias("timestamp"),
        "inputUrl",
        *[quoted(c) for c in lineage],
        F.lit("bronze").alias("_source_layer"),
    )


def comments_view(
    reels: DataFrame,
    element: T.StructType = COMMENT,
    keep_empty: bool = False,
    max_length: int = MAX_COMMENT_LENGTH,
) -> DataFrame:
    """Wide form: every reel column beside every comment field, dotted names for nested fields.

    Names used on both sides get the suffixes ``_reel`` and ``_comment``. With ``keep_empty`` a reel without
    comments keeps one row.
    """
    if "latestComments" not in reels.columns:
        return reels.limit(0)
    exploded = explode_comments(reels, element, keep_empty=keep_empty)
    schema = exploded.schema["comment"].dataType
    leaves = flatten(F.col("comment"), schema)
    names = exploded.select(*leaves).columns
    reel_columns = [c for c in exploded.columns if c != "comment"]
    clash = set(names) & set(reel_columns)
    left = [quoted(c).alias(c + "_reel" if c in clash else c) for c in reel_columns]
    right = [leaf.alias(n + "_comment" if n in clash else n) for leaf, n in zip(leaves, names)]
    wide = exploded.select(*left, *right)
    body = first_present(wide, ["text", "text_comment"])
    if body is None:
        body = "text"
        wide = wide.withColumn("text", F.lit(""))
    wide = wide.drop(*COMMENT_NOISE).withColumn("comprimento texto", text_length(quoted(body)))
    return wide.where(F.col("`comprimento texto`") < max_length).dropDuplicates()
