"""Layer contracts and the conform operator that applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, LONG, INT, DOUBLE, BOOL = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)
INSTANT, LOCAL_TIME = T.TimestampType(), T.TimestampNTZType()


def contract(optional_and_required: list[tuple[str, T.DataType]], required: set[str]) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in optional_and_required])


# Column names, types and order of the stored tables.
_BRONZE_LINEAGE = [("_ingested_at", INSTANT), ("_run_id", TEXT), ("_source", TEXT)]
_SILVER_LINEAGE = [("_ingested_at", INSTANT), ("_run_id", TEXT), ("_source_layer", TEXT)]
_GOLD_LINEAGE = [("_run_id", TEXT), ("_generated_at", INSTANT)]
_BRONZE_REQUIRED = {"_ingested_at", "_run_id", "_source"}
_SILVER_REQUIRED = {"_ingested_at", "_run_id", "_source_layer"}
_GOLD_REQUIRED = {"_run_id", "_generated_at"}

BRONZE_PROFILES = contract(
    [
        ("id", TEXT), ("username", TEXT), ("fullName", TEXT), ("inputUrl", TEXT),
        ("followersCount", LONG), ("followsCount", LONG), ("postsCount", LONG), ("igtvVideoCount", LONG),
        ("verified", BOOL), ("private", BOOL), ("isBusinessAccount", BOOL), ("hasChannel", BOOL),
        ("joinedRecently", BOOL), ("businessCategoryName", TEXT), *_BRONZE_LINEAGE,
    ],
    _BRONZE_REQUIRED,
)
BRONZE_POSTS = contract(
    [
        ("id", TEXT), ("ownerId", TEXT), ("ownerUsername", TEXT), ("inputUrl", TEXT),
        ("commentsCount", LONG), ("likesCount", LONG), ("timestamp", TEXT), ("type", TEXT),
        ("shortCode", TEXT), ("caption", TEXT), ("videoViewCount", LONG), ("videoPlayCount", LONG),
        ("videoDuration", DOUBLE), ("locationName", TEXT), *_BRONZE_LINEAGE,
    ],
    _BRONZE_REQUIRED,
)
BRONZE_REELS = contract(
    [
        ("id", TEXT), ("ownerId", TEXT), ("ownerUsername", TEXT), ("ownerFullName", TEXT), ("inputUrl", TEXT),
        ("commentsCount", LONG), ("likesCount", LONG), ("videoViewCount", LONG), ("videoPlayCount", LONG),
        ("videoDuration", DOUBLE), ("timestamp", TEXT), ("type", TEXT), ("shortCode", TEXT), ("caption", TEXT),
        ("isSponsored", BOOL), ("isCommentsDisabled", BOOL), ("isPinned", BOOL), ("latestComments", TEXT),
        *_BRONZE_LINEAGE,
    ],
    _BRONZE_REQUIRED,
)
SILVER_PROFILES = contract(
    [
        ("id", TEXT), ("username", TEXT), ("fullName", TEXT), ("inputUrl", TEXT), ("followersCount", INT),
        ("followsCount", INT), ("postsCount", INT), ("verified", BOOL), ("private", BOOL),
        ("isBusinessAccount", BOOL), ("businessCategoryName", TEXT), *_SILVER_LINEAGE,
    ],
    {"id", "username", "followersCount", "followsCount", "postsCount", "verified", "private",
     "isBusinessAccount", *_SILVER_REQUIRED},
)
SILVER_POSTS = contract(
    [
        ("id", TEXT), ("ownerId", TEXT), ("ownerUsername", TEXT), ("inputUrl", TEXT), ("type", TEXT),
        ("commentsCount", LONG), ("likesCount", LONG), ("data_hora", LOCAL_TIME), ("Tipo", TEXT),
        ("shortCode", TEXT), ("caption", TEXT), ("videoPlayCount", LONG), ("videoDuration", DOUBLE),
        *_SILVER_LINEAGE,
    ],
    {"id", "ownerId", "ownerUsername", "commentsCount", "likesCount", "data_hora", "Tipo", *_SILVER_REQUIRED},
)
SILVER_REELS = contract(
    [
        ("id", TEXT), ("ownerId", TEXT), ("ownerUsername", TEXT), ("inputUrl", TEXT), ("type", TEXT),
        ("commentsCount", LONG), ("likesCount", LONG), ("videoPlayCount", LONG), ("videoDuration", DOUBLE),
        ("data_hora", LOCAL_TIME), ("Tipo", TEXT), ("shortCode", TEXT), ("isSponsored", BOOL),
        ("isCommentsDisabled", BOOL), ("isPinned", BOOL), ("Total de Engajamento", LONG), *_SILVER_LINEAGE,
    ],
    {"id", "ownerId", "ownerUsername", "commentsCount", "likesCount", "data_hora", "Tipo",
     "Total de Engajamento", *_SILVER_REQUIRED},
)
SILVER_COMMENTS = contract(
    [
        ("id_reel", TEXT), ("id_comment", TEXT), ("text", TEXT), ("comprimento texto", LONG),
        ("ownerUsername", TEXT), ("likesCount", LONG), ("repliesCount", LONG), ("timestamp", TEXT),
        ("inputUrl", TEXT), *_SILVER_LINEAGE,
    ],
    {"comprimento texto", *_SILVER_REQUIRED},
)
GOLD_ENGAGEMENT = contract(
    [
        ("id", TEXT), ("username", TEXT), ("fullName", TEXT), ("inputUrl", TEXT), ("followersCount", INT),
        ("followsCount", INT), ("postsCount", INT), ("TOTAL ENGAJAMENTO", LONG), ("% ENGAJAMENTO", DOUBLE),
        ("RECENCIA", DOUBLE), ("FREQUENCIA", DOUBLE), ("commentsSum", LONG), ("likesSum", LONG), ("count", LONG),
        ("minData", LOCAL_TIME), ("maxData", LOCAL_TIME), *_GOLD_LINEAGE,
    ],
    {"id", "username", "followersCount", "TOTAL ENGAJAMENTO", "% ENGAJAMENTO", "RECENCIA", "FREQUENCIA",
     "commentsSum", "likesSum", "count", *_GOLD_REQUIRED},
)
GOLD_SENTIMENT = contract(
    [
        ("id_reel", TEXT), ("id_comment", TEXT), ("text", TEXT), ("inputUrl", TEXT), ("repliesCount", LONG),
        ("likesCount", LONG), ("sentiment_label", TEXT), ("sentiment_score", DOUBLE), ("Topic", LONG),
        ("Name", TEXT), *_GOLD_LINEAGE,
    ],
    _GOLD_REQUIRED,
)
GOLD_CLUSTERS = contract(
    [
        ("id", TEXT), ("username", TEXT), ("cluster_label", LONG), ("cluster_algo", TEXT),
        ("cluster_score", DOUBLE), *_GOLD_LINEAGE,
    ],
    {"id", "username", "cluster_label", "cluster_algo", *_GOLD_REQUIRED},
)
GOLD_TOPICS = contract([("Topic", LONG), ("Name", TEXT), ("Count", LONG), *_GOLD_LINEAGE],
                       {"Topic", "Count", *_GOLD_REQUIRED})

CONTRACTS = {
    "bronze_profiles": BRONZE_PROFILES,
    "bronze_posts": BRONZE_POSTS,
    "bronze_reels": BRONZE_REELS,
    "silver_profiles": SILVER_PROFILES,
    "silver_posts": SILVER_POSTS,
    "silver_reels": SILVER_REELS,
    "silver_comments": SILVER_COMMENTS,
    "gold_engagement": GOLD_ENGAGEMENT,
    "gold_sentiment": GOLD_SENTIMENT,
    "gold_clusters": GOLD_CLUSTERS,
    "gold_topics": GOLD_TOPICS,
}

# Shape of one nested comment inside the JSON text of a short video.
COMMENT = T.StructType(
    [
        T.StructField("id", TEXT),
        T.StructField("text", TEXT),
        T.StructField("ownerUsername", TEXT),
        T.StructField("ownerProfilePicUrl", TEXT),
        T.StructField("timestamp", TEXT),
        T.StructField("repliesCount", LONG),
        T.StructField("likesCount", LONG),
        T.StructField(
            "owner",
            T.StructType(
                [
                    T.StructField("id", TEXT),
                    T.StructField("is_verified", BOOL),
                    T.StructField("profile_pic_url", TEXT),
                    T.StructField("username", TEXT),
                ]
            ),
        ),
    ]
)

# Load-time column types of already processed wide tables.
PROFILE_HINTS = {
    "inputUrl": TEXT, "id": TEXT, "username": TEXT, "followersCount": INT, "followsCount": INT,
    "hasChannel": BOOL, "isBusinessAccount": BOOL, "joinedRecently": BOOL, "businessCategoryName": TEXT,
    "private": BOOL, "verified": BOOL, "igtvVideoCount": INT, "postsCount": INT,
}
REEL_HINTS = {
    "inputUrl": TEXT, "id": TEXT, "type": TEXT, "commentsCount": LONG, "likesCount": LONG,
    "videoViewCount": LONG, "videoPlayCount": LONG, "alt": DOUBLE, "videoDuration": DOUBLE,
    "isSponsored": BOOL, "isCommentsDisabled": BOOL, "isPinned": DOUBLE, "data_hora": LOCAL_TIME, "Tipo": TEXT,
}


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def encode_nested(df: DataFrame) -> DataFrame:
    """Turn every array, struct and map column into JSON text."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    return df.withColumns({n: F.to_json(quoted(n)) for n in nested}) if nested else df


def conform(df: DataFrame, schema: T.StructType, check: bool = True) -> DataFrame:
    """Project ``df`` onto a contract: contract order, absent columns as null, cast, nulls refused where required.

    The null guard is part of the projection, so it costs no pass of its own and fails the write that
    would store a bad row.
    """
    present = {f.name: f.dataType for f in df.schema}
    columns = []
    for field in schema:
        if field.name in present:
            source = quoted(field.name)
            if field.dataType == TEXT and isinstance(
                present[field.name], (T.ArrayType, T.StructType, T.MapType)
            ):
                source = F.to_json(source)
            value = source.cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        if check and not field.nullable:
            refusal = F.raise_error(F.lit(f"null in required column {field.name}")).cast(field.dataType)
            value = F.coalesce(value, refusal)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def apply_hints(df: DataFrame, hints: dict[str, T.DataType]) -> DataFrame:
    """Cast the hinted columns that are there; leave the rest alone."""
    return df.withColumns({n: quoted(n).cast(t) for n, t in hints.items() if n in df.columns})


def columns_of(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    """Names of the columns of the given types; numeric kinds never include booleans."""
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.NumericType)


def boolean_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.BooleanType)


def present_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return [n for n in wanted if n in have]


def first_present(df: DataFrame, wanted: list[str]) -> str | None:
    return next(iter(present_columns(df, wanted)), None)


def column_or(df: DataFrame, name: str, default) -> Column:
    """The column if the table has it, else a constant."""
    return quoted(name) if name in df.columns else F.lit(default)
