import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engagelake.functions.casts import lenient_bool, lenient_int, lenient_long, pinned_flag, ratio, round_even
from engagelake.functions.dates import local_time, weekday_name, whole_days
from engagelake.functions.nested import decode_list, infer_element
from engagelake.functions.text import (
    EMOJI_BLOCKS,
    default_stopwords,
    demojize,
    merge_missing_prefix,
    remove_stopwords,
    strip_slash,
    text_length,
    tokens,
)


def values(spark, kind, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_lenient_integers(spark):
    raw = ["12", "1.7", "x", None, "1e3", " 5 ", "3e9", "-2.9", "1d"]
    assert values(spark, "string", raw, lenient_int) == [12, 1, 0, 0, 1000, 5, 0, -2, 0]
    assert values(spark, "string", ["3e9", "9007199254740993"], lenient_long) == [3_000_000_000, 9007199254740993]
    assert values(spark, "double", [1.9, None, 1e300], lambda c: lenient_int(c, T.DoubleType())) == [1, 0, 0]


def test_flags(spark):
    assert values(spark, "string", ["true", "false", None, "junk"], lenient_bool) == [True, False, False, False]
    assert values(spark, "string", ["TRUE", "1", "Yes", "1.0", "0", None, "no"], pinned_flag) == [
        True, True, True, True, False, False, False]
    assert values(spark, "double", [1.0, 0.0, None], pinned_flag) == [True, False, False]


def test_local_time_follows_the_zone_rules(spark):
    raw = ["2024-01-01T12:00:00+00:00", "2018-12-01T12:00:00Z", "junk", None]
    assert values(spark, "string", raw, local_time) == [
        datetime(2024, 1, 1, 9), datetime(2018, 12, 1, 10), None, None]


def test_whole_days_are_spans_not_dates(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 23:00:00' AS a, timestamp_ntz'2024-01-02 01:00:00' AS b")
    assert df.select(whole_days(F.col("a"), F.col("b"))).first()[0] == 0


def test_weekday_names(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS a")
    assert df.select(weekday_name(F.col("a"))).first()[0] == "Segunda-feira"


def test_rounding_and_ratio(spark):
    assert values(spark, "double", [0.125, 0.135], round_even) == [0.12, 0.14]
    df = spark.createDataFrame([(5, 0), (5, None), (5, 10)], "a int, b int")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.5]


def test_text(spark):
    assert values(spark, "string", ["  O  Rio de Janeiro ", None], lambda c: remove_stopwords(c, ["o", "de"])) == [
        "Rio Janeiro", ""]
    assert values(spark, "string", ["Olá mundo 😂 a ok"], tokens) == [["olá", "mundo", "😂", "ok"]]
    assert values(spark, "string", ["😂!", None], text_length) == [2, 0]
    assert values(spark, "string", ["a/", "a", "a//"], strip_slash) == ["a", "a", "a/"]
    assert values(spark, "string", ["None,X", "X"], merge_missing_prefix) == ["X", "X"]
    assert values(spark, "string", ["oi 😂", None], demojize()) == ["oi :face_with_tears_of_joy:", None]
    assert values(spark, "string", ["😂"], demojize({"😂": "rindo"})) == [":rindo:"]
    assert "de" in default_stopwords()


def sequences():
    """(emoji, name) by the rules of Unicode's sequence list."""
    out = [(c + v + "\u20e3", f"keycap_{c}") for c in "0123456789#*" for v in ("", "\ufe0f")]
    letters = "abcdefghijklmnopqrstuvwxyz"
    out += [(chr(0x1F1E6 + i) + chr(0x1F1E6 + j), f"flag_{letters[i]}{letters[j]}") for i in range(26) for j in range(26)]
    out += [("\U0001F3F4" + "".join(chr(0xE0000 + ord(c)) for c in place) + "\U000E007F", f"flag_{place}") for place in ("gbeng", "gbsct", "gbwls", "ustx")]
    tones = ["light", "medium-light", "medium", "medium-dark", "dark"]
    for base, name in (("\U0001F44D", "thumbs_up"), ("\U0001F469", "woman"), ("\U0001F64F", "folded_hands"), ("\u270C", "victory_hand")):
        out += [(base + chr(0x1F3FB + i), f"{name}_{tone}_skin_tone") for i, tone in enumerate(tones)]
    people = {"\U0001F468": "man", "\U0001F469": "woman", "\U0001F467": "girl", "\U0001F466": "boy"}
    for a, b in itertools.product("\U0001F468\U0001F469", repeat=2):
        for c in ("\U0001F467", "\U0001F466"):
            out.append(("\u200d".join([a, b, c]), f"family_{people[a]}_{people[b]}_{people[c]}"))
            out.append(("\u200d".join([a, b, c, "\U0001F466"]), f"family_{people[a]}_{people[b]}_{people[c]}_boy"))
    out += [("\U0001F469\u200d\U0001F4BB", "woman_technologist"), ("\U0001F9D1\U0001F3FE\u200d\u2695\ufe0f", "adult_health_worker_medium-dark_skin_tone"),
            ("\U0001F3C3\U0001F3FB\u200d\u2640\ufe0f", "woman_runner_light_skin_tone"), ("\U0001F937\u200d\u2642\ufe0f", "man_shrug"),
            ("\u2764\ufe0f\u200d\U0001F525", "heart_on_fire"), ("\U0001F3F3\ufe0f\u200d\U0001F308", "rainbow_flag"),
            ("\u2764\ufe0f", "red_heart"), ("\u2764", "red_heart"), ("\U0001F602", "face_with_tears_of_joy")]
    return out


def test_emoji_sequences_are_one_name_each(spark):
    known = sequences()
    apart = values(spark, "string", [e for e, _ in known], demojize())
    assert apart == [f":{n}:" for _, n in known]
    # Side by side the longest sequence still wins; text around stays.
    some = [known[0], *known[-40:]]
    text, want = "a1 ".join(e for e, _ in some), "a1 ".join(f":{n}:" for _, n in some)
    plain = ["x1", "", None, "12 #*", "\U0001F3FB", "\u200d", "7\ufe0f", "\U0001F1E7"]
    got = values(spark, "string", [text, *plain], demojize())
    assert got[0] == want and got[1:5] == plain[:4] and got[5] == ":emoji_modifier_fitzpatrick_type_1_2:" and got[6:8] == plain[5:7]
    assert values(spark, "string", ["\U0001F468\u200d\U0001F469\u200d\U0001F467"], demojize({"\U0001F468\u200d\U0001F469\u200d\U0001F467": "familia"})) == [":familia:"]


def test_emoji_names_need_no_python_worker(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(demojize()(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tokens_match_the_two_character_word_rule(spark):
    import re

    text = "Ünï_1 x yz 42 7 — d'água 🚀☀ naïve"
    # Fixed value: words of two characters or more, and single emoji of the blocks named in the package.
    blocks = "".join(f"{chr(low)}-{chr(high)}" for low, high in EMOJI_BLOCKS)
    words = re.compile(rf"(?u)\b\w\w+\b|[{blocks}]")
    assert values(spark, "string", [text], tokens) == [words.findall(text.lower())]


def test_json_lists(spark):
    item = T.StructType([T.StructField("id", T.StringType())])
    assert values(spark, "string", ['[{"id":"a"}]', "[]", None, "oops"], lambda c: F.size(decode_list(c, item))) == [1, 0, 0, 0]
    df = spark.createDataFrame([("oops",)], "v string")
    with pytest.raises(Exception):
        df.select(decode_list(F.col("v"), item, strict=True)).collect()
    df = spark.createDataFrame([('[{"a":1}]',), ('[{"b":{"c":"x"}}]',)], "v string")
    assert set(infer_element(df, "v").names) == {"a", "b"}
