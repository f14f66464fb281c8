"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

The base kinds (email, ip, card, phone) are found by pattern and checksum alone. Further kinds start with the score
of their pattern, gain by a checksum that holds, and gain or lose by the words around them; those that reach
LEAST_SCORE are added where they overlap no other span. All of it is linear in the length of a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engagelake.llm.common import query, read

#: Base kinds in the order of reports, then the added ones.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_group", "tax_id", "social_id", "local_phone")
#: Scores: what a span needs, what words nearby add or take, and how far they may be away (code points).
LEAST_SCORE, FOR, AGAINST, NEARBY = 0.6, 0.35, 0.3, 48
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
SCHEMA = "array<struct<kind:string,start:int,end:int,score:double>>"

#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats give the same matches as greedy ones here, and never go back over a long run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_GROUPS = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])")
_TAX = re.compile(r"(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.])(?:\(0?[0-9]{2,5}\)|0[0-9]{1,4})[ /-]?[0-9]{2,5}(?:[ -]?[0-9]{2,5}){1,3}(?![0-9.])")
_ANY_DIGIT = re.compile("[0-9]")
_WORDS = re.compile(r"[^\W\d_]+")


# --- proposals --------------------------------------------------------------------------------------------------------

def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ with the run of name characters before it, from the end of the address before on, and a domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def matches(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers cut to the length of their country, blanks not counted."""
    for match in _IBAN.finditer(text):
        wanted, end = IBAN_LENGTHS.get(match.group()[:2], 0), match.start()
        while wanted and end < match.end():
            wanted -= text[end] != " "
            end += 1
        if not wanted and end > match.start() and not text[end:end + 1].isalnum():
            yield match.start(), end


# --- checks -----------------------------------------------------------------------------------------------------------

def digits_of(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def luhn(value: str) -> bool:
    """The sum of the digits, every second from the right doubled (less 9 above 9), ends in 0."""
    digits = [int(c) for c in digits_of(value)][::-1]
    doubled = [2 * d - 9 * (d > 4) for d in digits[1::2]]
    return bool(digits) and (sum(digits[::2]) + sum(doubled)) % 10 == 0


def mod97(value: str) -> bool:
    """The first four characters moved behind the rest, letters as 10 to 35, leave 1 when divided by 97."""
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def mod11(value: str) -> bool:
    """Both check digits of an eleven-digit tax number; eleven equal digits are none."""
    digits = [int(c) for c in digits_of(value)]
    check = lambda n: (sum(d * (n + 1 - i) for i, d in enumerate(digits[:n])) * 10) % 11 % 10
    return len(set(digits)) > 1 and check(9) == digits[9] and check(10) == digits[10]


def octets(value: str) -> bool:
    """Every part is at most 255; leading zeros do not count."""
    parts = [p.lstrip("0") for p in value.split(".")]
    return all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts)


def issued(value: str) -> bool:
    """A social security number outside the ranges that are never given out."""
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def card(value: str, low: int = 16, high: int = 19) -> bool:
    n = len(value) - value.count(" ") - value.count("-")
    return low <= n <= high and luhn(value)


def phone(value: str) -> bool:
    return 8 <= len(digits_of(value)) <= 15


@dataclass(frozen=True)
class Recognizer:
    """What proposes spans, what confirms them, the score of both, and the words that speak for and against."""

    kind: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool]
    score: float
    context: frozenset[str]
    against: frozenset[str] = frozenset()


# Words near personal data in the languages of the corpus.
_CARD_WORDS = frozenset("card cards credit debit visa mastercard amex karte kreditkarte tarjeta carte crédito crédit cartão".split())
_PHONE_WORDS = frozenset("phone tel telephone mobile call fax telefon handy anruf teléfono móvil téléphone portable telefone celular".split())
_OTHER_NUMBERS = frozenset("order invoice isbn serial tracking version rechnung bestellung factura pedido facture commande".split())
RECOGNIZERS = (
    Recognizer("email", emails, lambda _: True, 0.9, frozenset("mail email contact kontakt correo courriel contato".split())),
    Recognizer("ip", matches(_IP), octets, 0.7, frozenset("ip address host server adresse dirección".split()), frozenset(["version", "release"])),
    Recognizer("card", matches(_DIGITS), card, 0.8, _CARD_WORDS, _OTHER_NUMBERS),
    Recognizer("phone", matches(_PHONE), phone, 0.8, _PHONE_WORDS),
    Recognizer("iban", accounts, mod97, 0.9, frozenset("iban account bank konto cuenta compte conta".split())),
    Recognizer("card_group", matches(_GROUPS), lambda v: card(v, 13), 0.65, _CARD_WORDS, _OTHER_NUMBERS),
    Recognizer("tax_id", matches(_TAX), mod11, 0.8, frozenset("cpf tax imposto contribuinte".split())),
    Recognizer("social_id", matches(_SOCIAL), issued, 0.3, frozenset("ssn social security".split()), _OTHER_NUMBERS),
    Recognizer("local_phone", matches(_LOCAL_PHONE), phone, 0.3, _PHONE_WORDS, _OTHER_NUMBERS),
)


def score_of(rule: Recognizer, text: str, start: int, end: int) -> float:
    """The score of a confirmed span after the words around it were read."""
    around = set(_WORDS.findall((text[max(start - NEARBY, 0):start] + " " + text[end:end + NEARBY]).lower()))
    score = rule.score + FOR * (not around.isdisjoint(rule.context)) - AGAINST * (not around.isdisjoint(rule.against))
    return round(min(max(score, 0.0), 1.0), 2)


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind in the order of RECOGNIZERS, then start; code points, end exclusive."""
    some_digit = _ANY_DIGIT.search(text) is not None
    base: list[tuple[str, int, int, float]] = []
    more: list[tuple[str, int, int, float]] = []
    for rule in RECOGNIZERS:
        if not (some_digit or (rule.kind == "email" and "@" in text)):
            continue
        for start, end in rule.propose(text):
            if rule.confirm(text[start:end]):
                found = (rule.kind, start, end, score_of(rule, text, start, end))
                if rule.kind in BASE:
                    base.append(found)
                elif found[3] >= LEAST_SCORE:
                    more.append(found)
    if more:
        base += free(base, more)
    return base


def free(base: list[tuple[str, int, int, float]], more: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Those of ``more`` that overlap no base span and none of their own with a higher score (then the earlier kind)."""
    kinds = {k: i for i, k in enumerate(ADDED)}
    out: list[tuple[str, int, int, float]] = []
    events = sorted([(s, e, -2.0, -1, None) for _, s, e, _ in base] + [(x[1], x[2], -x[3], kinds[x[0]], x) for x in more], key=lambda v: v[:4])
    # Spans that overlap in a chain are settled together, best first.
    chain: list[tuple] = []

    def settle() -> None:
        taken: list[tuple[int, int]] = []
        for start, end, _, _, span in sorted(chain, key=lambda v: (v[2], v[3], v[0])):
            if span is None or all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                if span is not None:
                    out.append(span)

    reach = -1
    for event in events:
        if event[0] >= reach:
            settle()
            chain.clear()
        chain.append(event)
        reach = max(reach, event[1])
    settle()
    return sorted(out, key=lambda x: (kinds[x[0]], x[1]))


def redacted(text: str, spans: list[dict]) -> str:
    """``text`` with a mark in the place of every span; spans of different kinds that overlap share the first one's mark."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            out += [text[at:span["start"]], f"<{span['kind'].upper()}>"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


# --- over tables ------------------------------------------------------------------------------------------------------

def with_pii(df: DataFrame, text: str = "text", into: str = "pii", clean: str | None = None) -> DataFrame:
    """Add ``into``, an array of (kind, start, end, score) over the whole text, by kind and start.

    ``clean``: also add a column of this name, the text with every span replaced by ``<KIND>``; null stays null. Null and
    empty texts have no spans. Columns of these names are replaced, all others stay; rows are independent of each other,
    so null ids, ties and repeated rows change nothing.
    """

    @F.arrow_udf(SCHEMA)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [spans_of(t or "") for t in batch.to_pylist()]
            yield pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in some] for some in found], pa.list_(SPAN))

    @F.arrow_udf("string")
    def mask(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
            yield pa.array([redacted(t, s) if t and s else t for t, s in pairs], pa.string())

    found = df.withColumn(into, find(F.coalesce(F.col(text), F.lit(""))))
    return found.withColumn(clean, mask(F.col(text), F.col(into))) if clean else found


def of_kinds(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op11_pii")
def _pii(spark, folder):
    """The personal data of all documents: base kinds counted and digested, all spans listed."""
    rows = with_pii(read(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.size(of_kinds("pii", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(listed(of_kinds("pii", *BASE)), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
