"""Personal data, fill-in-middle and the Merkle manifest against brute force, and on odd rows."""

import hashlib
import os
import random
import re
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engagelake.llm import fim, merkle, pii
from engagelake.llm.common import QUERIES, settings

FOLDER = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pii string, fim int, tree int, part int, idx string"
CARD, OTHER_CARD = "4929 3483-8514 6306", "7536784127813050"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward():
    """Rows with nulls in every column, empty and long texts, ties and repeats, and clashing names."""
    texts = [None, "", "\n\n", "a@b.c", f"mail to x.y+z@host.example.org, card {CARD}.", "10.0.0.256 10.1.2.3.4.5.6.7 0001.2.3.255",
             "+1 (017) 555-7713 +49 30", "<P>x<S>", "ab<", "1" * 60_000, "a" * 60_000, "a@" * 9_000, "+1" * 9_000, "1.2." * 9_000,
             "é日\n" * 9_000, "\U0001F602 4111 1111 1111 1111", f"{OTHER_CARD} {OTHER_CARD}", "IBAN DE89 3704 0044 0532 0130 00 ok",
             "call (030) 1234 5678 now", "order (030) 1234 5678", "ssn 536-22-1234", "cpf 529.982.247-25"]
    rows = [(i, t, ["en", None][i % 2], [None, "b", "a", "", "é"][i % 5], i or None, "p", 3, 4, 5, "i") for i, t in enumerate(texts)]
    hot = [(100 + i, f"line {i}\nand {i}", "de", "hot", i, None, None, None, None, None) for i in range(150)]
    return [*rows, rows[4], rows[4], (4, "other text", "en", "a", 1, None, None, None, None, None), *hot,
            (None, "lost\nid", None, "hot", None, None, None, None, None, None), (None,) * 10]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    settings(spark)
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(awkward(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < -1")


# --- 11 ------------------------------------------------------------------------------------------------------------------
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
DIGITS = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value // 10 + value % 10
    return total % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
    for m in re.finditer(DIGITS, text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and plain_luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def found(text, base=True):
    return [s[:3] for s in pii.spans_of(text) if (s[0] in pii.BASE) == base]


@given(st.text(alphabet="ab1.@-_%+ 4(0)", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert found(text) == base_spans(text)


@given(st.lists(st.sampled_from(["4929348385146306", "7536784127813050", " ", "-", "+", "1", "10.2.3.4", ".", "a@b.c", "_x@y.z", "é", "+49 30 1234567"]), max_size=12))
def test_base_spans_in_mixed_texts(pieces):
    text = "".join(pieces)
    assert found(text) == base_spans(text)
    spans = pii.spans_of(text)
    assert spans == sorted(spans, key=lambda s: ([r.kind for r in pii.RECOGNIZERS].index(s[0]), s[1]))
    for kind, start, end, score in spans:
        assert 0 <= start < end <= len(text) and 0 <= score <= 1
        if kind not in pii.BASE:  # an added span overlaps no other
            assert all(end <= a or start >= b for k, a, b, _ in spans if (k, a, b) != (kind, start, end))


def test_checks_and_context_decide_on_added_spans():
    assert found("IBAN DE89 3704 0044 0532 0130 00 ok", base=False) == [("iban", 5, 32)]
    assert found("DE88 3704 0044 0532 0130 00", base=False) == []
    assert found(f"{OTHER_CARD} 4845168114407329", base=False) == [("card_group", 0, 16), ("card_group", 17, 33)]
    assert found("378282246310005", base=False) == [("card_group", 0, 15)] and found("order 378282246310005", base=False) == []
    assert found("cpf 529.982.247-25", base=False) == [("tax_id", 4, 18)] and found("529.982.247-26", base=False) == []
    assert found("ssn 536-22-1234", base=False) == [("social_id", 4, 15)] and found("536-22-1234", base=False) == []
    assert found("ssn 666-22-1234", base=False) == []
    assert found("call (030) 1234 5678", base=False) == [("local_phone", 5, 20)] and found("see (030) 1234 5678", base=False) == []
    score = {t: pii.spans_of(t)[0][3] for t in (f"card {CARD}", CARD, f"order {CARD}")}
    assert score[f"card {CARD}"] > score[CARD] > score[f"order {CARD}"]


def test_pii_over_odd_rows(docs, nothing):
    rows = pii.with_pii(docs, clean="clean").collect()
    assert len(rows) == len(awkward()) and pii.with_pii(nothing, clean="clean").collect() == []
    for row in rows:
        text = row["text"] or ""
        spans = [(s["kind"], s["start"], s["end"]) for s in row["pii"]]
        assert [s for s in spans if s[0] in pii.BASE] == base_spans(text)
        assert (row["clean"] is None) == (row["text"] is None) and row["fim"] in (3, None)
        if not spans:
            assert row["clean"] == row["text"]
    clean = {r["text"]: r["clean"] for r in rows}
    assert clean["a@b.c"] == "<EMAIL>" and clean["\U0001F602 4111 1111 1111 1111"] == "\U0001F602 <CARD>"


@here
def test_pii_query_equals_brute_force(spark):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op11_pii"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = base_spans(texts[row["doc_id"]] or "")
        assert row["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert [s for s in row["spans"].split(",") if s.split(":")[0] in pii.BASE] == [f"{k}:{a}:{b}" for k, a, b in spans]


# --- 12 ------------------------------------------------------------------------------------------------------------------
def plain_fim(doc_id, text):
    pieces = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    key = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(key[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(pieces)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(pieces[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_units_in_stretches(monkeypatch):
    rng = random.Random(3)
    for stretch in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(fim, "STRETCH", stretch)
        for _ in range(60):
            text = "".join(rng.choice("abZ @[`{\né日\U0001F602<PSM>") for _ in range(rng.randrange(30)))
            pieces = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
            n, before = fim.units(text)
            assert n == len(pieces)
            assert [fim.place_of(text, before, k) for k in range(n + 1)] == [len("".join(pieces[:k])) for k in range(n + 1)]
            table = fim.PieceTable(text)
            assert table.text() == text and table.sha256() == sha(text)


@given(st.integers(), st.text(alphabet="aB<PSM> \n\U0001F602", max_size=40))
def test_every_form_restores(key, text):
    n, form, table = fim.arrange(key, text)
    assert (n, form, table.text()) == (*plain_fim(key, text)[:2], plain_fim(key, text)[4])
    assert fim.disarrange(table.text(), form).text() == text and table.sha256() == sha(table.text())


def test_fim_over_odd_rows(docs, nothing):
    rows = fim.with_restored(fim.with_fim(docs).select("doc_id", "text", "pii", "fim.*"), "output", "form").collect()
    assert len(rows) == len(awkward()) and fim.with_fim(nothing).collect() == []
    for r in rows:
        text = r["text"] or ""
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], text)
        assert r["output_sha256"] == sha(r["output"]) and r["back"]["restored"] == text and r["back"]["restored_sha256"] == sha(text)


@here
def test_fim_query_equals_brute_force(spark):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op12_fim"](spark, FOLDER).collect()
    assert len(rows) == len(texts) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        n, form, prefix, middle, output = plain_fim(r["doc_id"], texts[r["doc_id"]] or "")
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == sha(output) and r["restored_sha256"] == sha(texts[r["doc_id"]] or "")


# --- 13 ------------------------------------------------------------------------------------------------------------------
def encoded(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree_of(nodes):
    """(root, siblings before and after of every leaf, level by level) by recursion over whole levels."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at, strict=True):
            low = i // 3 * 3
            way.append((nodes[low:i], nodes[i + 1:low + 3]))
        at = [i // 3 for i in at]
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def plain_manifest(rows):
    """All rows (doc_id, source, lang, n_chars, text) as the result has them, sorted."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0], sha(encoded(*r)), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        leaves = sorted(by_source[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *tree_of([x[1] for x in leaves])))
    root, tops = tree_of([t[1] for t in trees])
    out = []
    for (leaves, subroot, ways), top in zip(trees, tops, strict=True):
        for (doc_id, own, r), way in zip(leaves, ways, strict=True):
            proof = sha("".join("".join(a + b) for a, b in way + top))
            text = r[4]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = sha(encoded(*r[:4], text))
            for a, b in way + top:
                node = sha("".join([*a, node, *b]))
            out.append((doc_id, own, subroot, root, proof, node, node == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def shown(docs):
    rest = [F.col(c) for c in merkle.FIELDS[:-1]]
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return docs.select("doc_id", "source", merkle.leaf(*rest, F.col("text")).alias("leaf"),
                       F.when(changed, merkle.leaf(*rest, F.translate("text", "\n", ""))).alias("shown"))


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(2, 30, 20)])
def test_manifest_of_odd_rows_in_all_shapes(docs, shape):
    rows = merkle.with_proofs(shown(docs), shape=shape).withColumn("verified", F.col("folded_root") == F.col("root"))
    assert sorted((tuple(r) for r in rows.select(COLUMNS).collect()), key=str) == plain_manifest(manifest_rows(docs))


def test_manifest_of_small_tables(docs, nothing):
    assert merkle.with_proofs(shown(nothing)).collect() == []
    for some in (docs.where("doc_id = 3"), docs.where("doc_id < 9")):
        rows = merkle.with_proofs(shown(some), with_proof=True, shape=merkle.Shape(1, 7, 5)).collect()
        assert sorted(((*r[:6], r["folded_root"] == r["root"]) for r in rows), key=str) == plain_manifest(manifest_rows(some))
        for r in rows:
            assert merkle.folded(r["leaf"], [(p["before"], p["after"]) for p in r["proof"]]) == r["root"]


def test_a_part_asks_for_each_node_once_and_for_none_it_has():
    import numpy as np

    trees, n = 4, 40
    hand = np.array([0, 1, 2, 3, 30])
    asked = merkle.lacking(np.zeros(5, int), np.zeros(5, int), np.full(5, n), hand, trees)
    assert len(asked) == len(set(asked))
    # 0 to 2 are whole; 3 lacks 4 and 5; 30 lacks 31 and 32; then 0, 1, 10 of 14 are at hand, and so on up.
    assert [a for a in asked if a[0] == 0 and a[1] == 0] == [(0, 0, 4), (0, 0, 5), (0, 0, 31), (0, 0, 32)]
    assert [a for a in asked if a[0] == 0 and a[1] == 1] == [(0, 1, 2), (0, 1, 9), (0, 1, 11)]
    assert [a for a in asked if a[0] == 0 and a[1] == 2] == [(0, 2, 1), (0, 2, 2), (0, 2, 4)]
    assert [a for a in asked if a[0] == merkle.TOP] == [(merkle.TOP, 0, 1), (merkle.TOP, 0, 2), (merkle.TOP, 1, 1)]


@here
def test_manifest_query_equals_brute_force(spark):
    rows = QUERIES["op13_merkle"](spark, FOLDER)
    assert rows.columns == COLUMNS
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert sorted((tuple(r) for r in rows.collect()), key=str) == plain_manifest(manifest_rows(documents))
