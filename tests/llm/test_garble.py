import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterloom.llm import garble as G
from quarterloom.llm.columns import counts, text_bytes

TEXT = "Célia Velström said we’re fine — naïve “à jour” at £12 or €40 ½ Вега Γ-series √t SÃO ÂGORA Å-Âme"


@pytest.mark.parametrize("codec", G.WRONG_DECODERS)
def test_round_trip(codec):
    plain = "Célia Velström said we’re fine — Zoë, Noël, João and Müller"
    once = G._decode(plain.encode(), codec)
    twice = G._decode(once.encode(), codec)
    for bad in (once, twice):
        assert G.is_garbled(bad)
        assert G.restore(bad)[0] == plain
    # Only the garbled part of a mixed text changes.
    assert G.restore(once + " | " + TEXT)[0] == plain + " | " + TEXT


def test_correct_text_is_left_alone():
    assert not G.is_garbled(TEXT) and G.restore(TEXT) == (TEXT, 0, 0)
    for fine in ("Did it help?Yes, it did.", "see example/deck?page=3 for reference", "Why? Because.", "", "plain"):
        assert not G.is_garbled(fine), fine


@pytest.mark.parametrize("first", G.WRONG_DECODERS)
@pytest.mark.parametrize("second", G.WRONG_DECODERS)
def test_chains_of_two_decoders(first, second):
    plain = "Célia said we’re fine — João and Müller, €40"
    bad = G._decode(G._decode(plain.encode(), first).encode(), second)
    assert G.is_garbled(bad) and G.restore(bad)[0] == plain


@pytest.mark.parametrize("codec", G.WRONG_DECODERS)
def test_emoji_and_kana(codec):
    plain = "good 😀 day, コール です"
    assert G.restore(G._decode(plain.encode(), codec))[0] == plain


@pytest.mark.parametrize("codec", ["cp1252", "latin-1"])
def test_ideographs(codec):
    plain = "取締役会 says 안녕"
    assert G.restore(G._decode(plain.encode(), codec))[0] == plain


@pytest.mark.parametrize(("true", "wrong"), [("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp1253")])
def test_one_single_byte_encoding_read_as_another(true, wrong):
    plain = "Célia and Noël met Rénée"
    bad = plain.encode(true).decode(wrong)
    assert G.is_garbled(bad) and G.restore(bad)[0] == plain
    assert G.is_garbled("Müller".encode("cp1252").decode("mac_roman"))


def test_cyrillic():
    plain = "Наш отчёт готов"
    assert G.restore(plain.encode("cp1251").decode("latin-1"))[0] == plain
    assert G.restore(plain.encode("koi8-r").decode("cp1251"))[0] == plain
    assert G.restore(G._decode(plain.encode(), "cp1251"))[0] == plain
    for fine in ("Рёбра и Рёв", "Γειά σου, Δx and kΩ", plain, "åäö ÅÄÖ", "col·lapse", "C'est vrai ? Oui.", "C'est vrai ? demanda-t-il.", "Vous venez ? oui"):
        assert not G.is_garbled(fine) and G.restore(fine)[0] == fine, fine


def test_lost_characters():
    for bad in ("we don?t see", "Bj?rn said", "NO?L spoke", "Thanks, Zo?, and", "cautious ? but fine", "we�re", "it\x92s"):
        assert G.is_garbled(bad), bad
    assert G.restore("we don?t know")[0] == "we don’t know"
    assert G.restore("Bj?rn")[2] == 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aZ ?é’ÃÂâ€™\u0080\u0099�√©Γ├Гв.,:=/\n", max_size=40))
def test_suspects_miss_nothing(text):
    (marked,) = G.suspects(pa.array([text]))
    assert marked or not G.is_garbled(text)


def test_columns():
    data, starts = text_bytes(pa.array(["ab", None, "", "é\n", "x\n\n"]).slice(1))
    assert bytes(data) == "é\nx\n\n".encode() and list(starts) == [0, 0, 0, 3, 6]
    assert list(counts(data == 10, starts)) == [0, 0, 1, 2]
    assert len(text_bytes(pa.array([], pa.string()))[0]) == 0


def test_frames(spark):
    long = "a" * 200_000
    df = spark.createDataFrame([(1, "weâ€™re", "x"), (2, "fine", "x"), (3, None, None), (4, "", "x"), (1, "weâ€™re", "x"), (5, long + "Ã©", "x")], "id bigint, body string, restored string")
    assert sorted(r.rec_id for r in G.garbled_ids(df, "id", "body").collect()) == [1, 1, 5]
    got = {r.rec_id: r for r in G.garbled_records(df, "id", "body").collect()}
    assert got[1].restored == "we’re" and got[5].restored == long + "é" and got[5].spans == 1
    assert G.garbled_ids(df.limit(0), "id", "body").count() == 0
