"""Text functions on columns."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode blocks counted as single-character tokens.
EMOJI_BLOCKS = [
    (0x1F300, 0x1F5FF),
    (0x1F600, 0x1F64F),
    (0x1F680, 0x1F6FF),
    (0x2600, 0x26FF),
    (0x2700, 0x27BF),
]
# Further blocks that hold emoji: names are spelled out for all of them, tokens are not made of them.
NAMED_BLOCKS = [*EMOJI_BLOCKS, (0x1F000, 0x1F2FF), (0x1F650, 0x1F67F), (0x1F700, 0x1FAFF), (0x2300, 0x23FF), (0x2B00, 0x2BFF), (0x2934, 0x2935)]
# Common names that differ from the Unicode ones.
SHORT_NAMES = {
    "\u2764": "red_heart", "\U0001F970": "smiling_face_with_hearts", "\U0001F44D": "thumbs_up", "\U0001F44E": "thumbs_down",
    "\U0001F44F": "clapping_hands", "\U0001F64F": "folded_hands", "\U0001F525": "fire", "\U0001F4AA": "flexed_biceps",
    "\U0001F60D": "smiling_face_with_heart-eyes", "\U0001F618": "face_blowing_a_kiss", "\u2728": "sparkles",
}
# The Portuguese stop words that Spark ships.
PORTUGUESE_STOPWORDS = """
de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos
já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu
às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos lhes meus minhas teu tua teus
tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas isto aquilo estou está estamos
estão estive esteve estivemos estiveram estava estávamos estavam estivera estivéramos esteja estejamos estejam estivesse
estivéssemos estivessem estiver estivermos estiverem hei há havemos hão houve houvemos houveram houvera houvéramos haja
hajamos hajam houvesse houvéssemos houvessem houver houvermos houverem houverei houverá houveremos houverão houveria
houveríamos houveriam sou somos são era éramos eram fui foi fomos foram fora fôramos seja sejamos sejam fosse fôssemos
fossem for formos forem serei será seremos serão seria seríamos seriam tenho tem temos tém tinha tínhamos tinham tive
teve tivemos tiveram tivera tivéramos tenha tenhamos tenham tivesse tivéssemos tivessem tiver tivermos tiverem terei
terá teremos terão teria teríamos teriam
""".split()
# Parts of emoji sequences. Variation selector, joiner, blocks of flag letters and of tags.
VARIANT, JOINER, REGIONAL, TAGS = "\ufe0f", "\u200d", (0x1F1E6, 0x1F1FF), (0xE0020, 0xE007E)
SKIN_TONES = ["light_skin_tone", "medium-light_skin_tone", "medium_skin_tone", "medium-dark_skin_tone", "dark_skin_tone"]
# Man, woman, boy, girl, adult, child, baby, older adult.
PEOPLE = ["\U0001F468", "\U0001F469", "\U0001F466", "\U0001F467", "\U0001F9D1", "\U0001F9D2", "\U0001F476", "\U0001F9D3"]
# What a person joined to a thing is called.
PROFESSIONS = {
    "\u2695": "health_worker", "\U0001F393": "student", "\U0001F3EB": "teacher", "\u2696": "judge", "\U0001F33E": "farmer",
    "\U0001F373": "cook", "\U0001F527": "mechanic", "\U0001F3ED": "factory_worker", "\U0001F4BC": "office_worker",
    "\U0001F52C": "scientist", "\U0001F4BB": "technologist", "\U0001F3A4": "singer", "\U0001F3A8": "artist", "\u2708": "pilot",
    "\U0001F680": "astronaut", "\U0001F692": "firefighter", "\U0001F9AF": "with_white_cane", "\U0001F9BC": "in_motorized_wheelchair",
    "\U0001F9BD": "in_manual_wheelchair", "\U0001F9B0": "red_hair", "\U0001F9B1": "curly_hair", "\U0001F9B3": "white_hair",
    "\U0001F9B2": "bald", "\U0001F37C": "feeding_baby",
}
# Joined emoji with names of their own.
SEQUENCES = {
    "\u2764\u200d\U0001F525": "heart_on_fire", "\u2764\u200d\U0001FA79": "mending_heart", "\U0001F3F3\u200d\U0001F308": "rainbow_flag",
    "\U0001F3F3\u200d\u26A7": "transgender_flag", "\U0001F3F4\u200d\u2620": "pirate_flag", "\U0001F415\u200d\U0001F9BA": "service_dog",
    "\U0001F408\u200d\u2B1B": "black_cat", "\U0001F43B\u200d\u2744": "polar_bear", "\U0001F441\u200d\U0001F5E8": "eye_in_speech_bubble",
    "\U0001F62E\u200d\U0001F4A8": "face_exhaling", "\U0001F635\u200d\U0001F4AB": "face_with_spiral_eyes", "\U0001F636\u200d\U0001F32B": "face_in_clouds",
}
_EMOJI_CLASS = "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in EMOJI_BLOCKS)
# Runs of two or more letters, digits or underscores of any script, or one emoji.
TOKEN_PATTERN = rf"[\p{{L}}\p{{N}}_]{{2,}}|[{_EMOJI_CLASS}]"


def strip_slash(c: Column) -> Column:
    """Drop one trailing slash of a link."""
    return F.regexp_replace(c, "/$", "")


def text_length(c: Column) -> Column:
    """Length in code points, 0 for null."""
    return F.coalesce(F.length(c), F.lit(0)).cast("bigint")


def default_stopwords(language: str = "portuguese") -> list[str]:
    """The Portuguese list of this package; for another language Spark's own list, which needs a running session."""
    if language == "portuguese":
        return list(PORTUGUESE_STOPWORDS)
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords(language))


def remove_stopwords(c: Column, stopwords: list[str]) -> Column:
    """Blank-separated words without stop words, joined by one blank; null gives empty text."""
    stops = sorted({w.lower() for w in stopwords})
    words = F.split(c.cast("string"), r"(?U)\s+")
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(stops) if stops else w != "")
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-case tokens as an array."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def _unicode_names() -> dict[str, str]:
    """Names of all single emoji by the rule: the Unicode name in lower case with underscores; the short ones instead where there are."""
    found = {}
    for low, high in NAMED_BLOCKS:
        for char in map(chr, range(low, high + 1)):
            name = unicodedata.name(char, "").lower().replace(" ", "_").replace("-", "_")
            if name:
                found[char] = name
    return found | SHORT_NAMES


def _constant(values: dict[str, str]) -> Column:
    """A map as one literal: the optimizer folds it once per plan."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _inside(block: tuple[int, int]) -> str:
    return rf"\x{{{block[0]:X}}}-\x{{{block[1]:X}}}"


def demojize(names: dict[str, str] | None = None):
    """Column function that writes each emoji as ``:name:``; generated from Spark's own expressions.

    The longest sequence at a place is one emoji: people joined to a family, a person with a profession or a sex, a skin
    tone, a keycap, a flag of two letters or of tags. Names are the given ones (also of whole sequences), then the
    common short ones, then the Unicode names; what sequences are called follows from their parts. Variation selectors
    after an emoji go with it.
    """
    given, tones = dict(names or {}), dict(zip(map(chr, range(0x1F3FB, 0x1F400)), SKIN_TONES, strict=True))
    table, sequences = _constant(_unicode_names() | given), _constant(SEQUENCES | {k.replace(VARIANT, ""): v for k, v in given.items()})
    jobs, skin = _constant(PROFESSIONS), _constant(tones)
    tone = f"[{_inside((0x1F3FB, 0x1F3FF))}]"
    single = f"[{''.join(map(_inside, NAMED_BLOCKS))}]{VARIANT}?{tone}?{VARIANT}?"
    flag, keycap = rf"[{_inside(REGIONAL)}]{{2}}", rf"[0-9#*]{VARIANT}?\x{{20E3}}"
    tagged = rf"\x{{1F3F4}}[{_inside(TAGS)}]+\x{{E007F}}"
    pattern = f"{flag}|{keycap}|{tagged}|{single}(?:{JOINER}{single})*"
    letters = "abcdefghijklmnopqrstuvwxyz"
    regional = "".join(chr(REGIONAL[0] + i) for i in range(26))
    tags = "".join(chr(0xE0061 + i) for i in range(26)) + "".join(chr(0xE0030 + i) for i in range(10))

    def base(part: Column) -> Column:
        return F.regexp_replace(part, f"{VARIANT}|(?<!^){tone}", "")

    def suffix(part: Column) -> Column:
        found = F.element_at(skin, F.regexp_extract(part, f"(?<!^){tone}", 0))
        return F.coalesce(F.concat(F.lit("_"), found), F.lit(""))

    def named(part: Column) -> Column:
        return F.coalesce(F.element_at(table, base(part)), base(part))

    def joined(parts: Column) -> Column:
        first, second = F.element_at(parts, 1), base(F.element_at(parts, 2))
        person = F.element_at(table, base(first))
        pair = F.size(parts) == 2
        bare = F.array_join(F.transform(parts, base), JOINER)
        return (
            F.when(F.element_at(sequences, bare).isNotNull(), F.concat(F.element_at(sequences, bare), suffix(first)))
            .when(pair & F.element_at(jobs, second).isNotNull() & base(first).isin(*PEOPLE), F.concat(person, F.lit("_"), F.element_at(jobs, second), suffix(first)))
            .when(pair & (second == "\u2640"), F.concat(F.lit("woman_"), named(first), suffix(first)))
            .when(pair & (second == "\u2642"), F.concat(F.lit("man_"), named(first), suffix(first)))
            .when(F.forall(parts, lambda p: base(p).isin(*PEOPLE)), F.concat(F.lit("family_"), F.array_join(F.transform(parts, named), "_")))
            .otherwise(F.array_join(F.transform(parts, lambda p: F.concat(named(p), suffix(p))), "_"))
        )

    def spelled(emoji: Column) -> Column:
        parts = F.split(emoji, JOINER)
        alone = F.element_at(parts, 1)
        name = (
            F.when(emoji.rlike(f"^{flag}$"), F.concat(F.lit("flag_"), F.translate(emoji, regional, letters)))
            .when(emoji.rlike(f"^{keycap}$"), F.concat(F.lit("keycap_"), F.substring(emoji, 1, 1)))
            .when(emoji.rlike(f"^{tagged}$"), F.concat(F.lit("flag_"), F.translate(F.regexp_replace(emoji, r"[\x{1F3F4}\x{E007F}]", ""), tags, letters + "0123456789")))
            .when(F.size(parts) > 1, joined(parts))
            .otherwise(F.concat(F.element_at(table, base(alone)), suffix(alone)))
        )
        whole = F.coalesce(F.element_at(sequences, base(emoji)), name) if given else name
        return F.coalesce(F.concat(F.lit(":"), F.regexp_replace(whole, "^:+|:+$", ""), F.lit(":")), emoji)

    def apply(c: Column | str) -> Column:
        text = F.col(c) if isinstance(c, str) else c
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spelled)
        mended = F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda piece, name: F.concat(piece, F.coalesce(name, F.lit("")))), "")
        return F.when(text.rlike(pattern), mended).otherwise(text)

    return apply


def merge_missing_prefix(c: Column) -> Column:
    """Category text without a leading ``None,``."""
    return F.regexp_replace(c, "^None,", "")
