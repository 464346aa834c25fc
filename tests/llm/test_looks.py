import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterweave.llm import looks
from rasterweave.llm.looks import Rules, canonical, canonical_text, compiled, look_classes, mapping, same_look

SAME = [
    ("The bark", "Ｔｈｅ　ｂａｒｋ"),
    ("café", "café"),
    ("café", "cаfе́"),
    ("a b", "a b"),
    ("a b", "a b"),
    ("bark", "ba​rk"),
    ("bark", "b­a⁠r﻿k"),
    ("The wet site", "Тһе wеt ѕіtе"),
    ("ё", "ë"),
    ("ﾊﾞ", "バ"),
    ("ｶﾞ", "ガ"),
    ("각", "각"),
    ("각", "ᄀ​ᅡᆨ"),
    ("ệ", "ệ"),
    ("K", "K"),
    ("é", "e​́"),
    ("ü", "ü‍"),
    ("Ρο", "Pο"),
    ("3\x7f３", "33"),
    ("\x01é", "é"),
    ("ㅤa", " a"),
    ("ậ", "ậ"),
    ("áb̖́", "áb̖́"),
]
DIFFERENT = [("m2", "m²"), ("cafe", "café"), ("a b", "a  b"), ("a b", "ab"), ("No", "no"), ("a.", "a;"), ("O", "0"), ("l", "I"), ("α", "a"), ("a\tb", "a b"), ("…", "..."), ("か", "が"), ("ᄀ", "ᄁ"), ("№", "No"), ("ß", "ss")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert canonical_text(a) == canonical_text(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert canonical_text(a) != canonical_text(b)


def test_the_mapping_is_checked_and_complete(monkeypatch):
    assert len(mapping()) > 300 and all(canonical_text(v) == v for v in mapping().values())
    monkeypatch.setattr(looks, "LOOK_ALIKES", "a а\nb а")
    with pytest.raises(ValueError):
        mapping()
    monkeypatch.setattr(looks, "LOOK_ALIKES", "a б\nб в\nв г")
    with pytest.raises(ValueError):
        mapping()


def test_clusters_are_keys_whatever_their_parts():
    keys = compiled()
    assert len(keys) > 20_000 and max(map(len, keys)) > 3
    some = {"\uff76\uff9e": "\u30ac", "\u0430\u0301": "\u00e1", "\u0415\u0308": "\u00cb", "\u1100\u1161\u11a8": "\uac01", "\uac00\u11a8": "\uac01", "\uff45\u0302\u0301": "\u1ebf"}
    assert {k: keys[k] for k in some} == some
    assert all(canonical_text(v) == v and canonical_text(k) == v for k, v in keys.items())
    with pytest.raises(ValueError):
        keys.put("а", "b")


def test_drawn_blanks_go_through_the_check():
    rules = Rules({"ㅤ": "x"})
    with pytest.raises(ValueError):
        rules.put("ㅤ", " ")
    assert all(mapping()[c] == " " for c in looks.DRAWN_BLANK)


ALPHABET = st.text(st.sampled_from("ab ẹ́́̈еоА​­　 ｅガﾞ각가²…🌲\n"), max_size=12)


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_a_form_is_its_own_form_and_composed(text):
    once = canonical_text(text)
    assert canonical_text(once) == once
    assert unicodedata.normalize("NFC", once) == once


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_composition_never_matters(text):
    assert canonical_text(unicodedata.normalize("NFD", text)) == canonical_text(unicodedata.normalize("NFC", text)) == canonical_text(text)


def test_whole_texts_nulls_and_long_ones(spark):
    long = "wеt " * 50_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long)], "doc_id long, text string")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", canonical(F.col("text")).alias("c")).collect()}
    assert got == {1: None, 2: "", 3: "wet " * 50_000}


def test_pairs_against_brute_force(spark):
    rows = [(1, "bark"), (2, "bаrk"), (3, "bark"), (4, "ba​rk"), (5, "…"), (6, "​…"), (7, None), (8, ""), (9, "​"), (None, "bаrk"), (10, "Bark"), (2, "bаrk"), (11, "x"), (12, "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, _look string")
    seen = {(a, b) for a, s in rows for b, t in rows if a and b and s and t and a < b and s != t and canonical_text(s) == canonical_text(t) and any(c.isalnum() for c in s)}
    for limit in (1, 1000):
        got = same_look(df, "doc_id", "text", rows_per_task=limit).collect()
        assert sorted((r["doc_id_a"], r["doc_id_b"]) for r in got) == sorted(seen)
        classes = {r["doc_id"]: (r["look_class"], r["n_members"], r["n_links"]) for r in look_classes(df, "doc_id", "text", rows_per_task=limit).collect()}
        assert classes == {k: (1, 4, n) for k, n in ((1, 2), (2, 3), (3, 2), (4, 3))}
    assert same_look(df.limit(0), "doc_id", "text").collect() == [] and look_classes(df.limit(0), "doc_id", "text").collect() == []


def test_each_text_is_formed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(looks, "cut_lineage", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    looks.look_digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text")
    assert seen[0].count("InArrow") == 1 and "EvalPython" not in seen[0]
