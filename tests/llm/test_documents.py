import random

import numpy as np
import pytest

from quarterloom.llm import languages as L
from quarterloom.llm import tokenizer as B

pytest.importorskip("public_tokenizers")


def brute(ranks, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def test_merges_against_brute_force():
    one = B.encoder()
    rng = random.Random(1)
    for _ in range(150):
        data = bytes(rng.choices(b"etaoin shrdlu\xc3\xa9\xe2\x80\x99", k=rng.randint(1, 60)))
        assert one.merge(data) == brute(one.ranks, data)
    # Ranks that give a merge a lower-ranked successor.
    odd = B.Encoder({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"bc": 4, b"ab": 5}, r".+")
    for text in ("abcab", "aabcbc", "ababab", "bcabc"):
        assert odd.merge(text.encode()) == brute(odd.ranks, text.encode())


def test_like_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    one = B.encoder()
    for text in ("Hello world, it's 2024!", "<|endoftext|>", "日本語 テスト 👩‍💻", " \n\n  x\t", "a" * 30_000, "é́ſ", "ab" * 5000):
        assert one.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert one.encode("") == [] and one.encode(None) == []


def test_encoded_frame(spark):
    df = spark.createDataFrame([(1, "hi there", "x"), (2, None, "x"), (3, "", "x"), (1, "hi there", "x")], "id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in B.encoded(df, "id", "text").collect())
    assert got == [(1, [5303, 612]), (1, [5303, 612]), (2, []), (3, [])]
    assert B.encoded(df.limit(0), "id", "text").count() == 0


SENTENCES = {
    "en": "The board approved a dividend and we expect demand to be {0} this year. There is still uncertainty around the {0} plant.",
    "de": "Der Vorstand schlägt eine Dividende vor und wir rechnen mit einer {0} Nachfrage. Es gibt noch Unsicherheit über das {0} Werk.",
    "nl": "Het bestuur stelt een dividend voor en we verwachten een {0} vraag. Er is nog veel onzekerheid over de {0} vestiging.",
    "sv": "Styrelsen föreslår en utdelning och vi räknar med en {0} efterfrågan. Det råder stor osäkerhet kring den {0} anläggningen.",
    "fr": "Le conseil propose un dividende et nous attendons une demande {0} cette année. Il reste beaucoup d'incertitude sur le site {0}.",
    "es": "El consejo propone un dividendo y esperamos una demanda {0} este año. Todavía hay mucha incertidumbre sobre la planta {0}.",
    "pt": "O conselho propõe um dividendo e esperamos uma procura {0} este ano. Ainda há muita incerteza em relação à fábrica {0}.",
    "it": "Il consiglio propone un dividendo e ci aspettiamo una domanda {0} quest'anno. C'è ancora molta incertezza sullo stabilimento {0}.",
    "ja": "取締役会は配当を提案いたします。下期の需要は{0}横ばいと見込んでいます。",
}


def corpus():
    rows, k = [], 0
    for lang, text in SENTENCES.items():
        for n in range(12):
            k += 1
            rows.append((k, text.format(f"kal{n} mor{n}"), lang, "x"))
    mixed = SENTENCES["en"].format("solid") + " " + SENTENCES["es"].format("firme")
    rows += [(901, SENTENCES["de"].format("neue"), "fr", "x"), (902, SENTENCES["it"].format("nuova"), None, "x"), (903, SENTENCES["en"].format("new"), "und", "x"), (904, SENTENCES["sv"].format("ny"), "Swedish", "x"), (905, mixed, "en", "x")]
    rows += [(906, None, "en", "x"), (907, "", None, "x"), (908, " \n ", "und", "x"), (909, "12345 !!! 678", "en", "x"), (910, SENTENCES["pt"].format("nova") * 300, "pt-BR", "x")]
    return rows


def test_languages(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, confidence string")
    got = sorted((r.doc_id, r.lang) for r in L.label_errors(df).collect())
    assert got == [(901, "de"), (902, "it"), (903, "en"), (905, "en"), (905, "es")]
    runs = [(r.lang, r.confidence) for r in L.language_segments(df).where("doc_id = 905").orderBy("segment_no").collect()]
    assert [a for a, _ in runs] == ["en", "es"] and all(0.5 < b <= 1 for _, b in runs)
    assert L.label_errors(df.limit(0)).count() == 0


def test_held_out_accuracy():
    texts, langs = [], []
    for lang in L.LATIN:
        for n in range(30):
            for s in L.sentences(SENTENCES[lang].format(f"bel{n}")):
                texts.append(L.normal(s))
                langs.append(lang)
    order = np.random.default_rng(1).permutation(len(texts))
    train, test = order[: len(order) // 2], order[len(order) // 2 :]
    model = L.fit([texts[i] for i in train], [langs[i] for i in train])
    best, sure = L.judged(L.scores(model, [texts[i] for i in test]))
    assert np.mean([L.LATIN[b] == langs[i] for b, i in zip(best, test)]) > 0.99


def test_sentences():
    assert L.sentences("Wir haben 150 Mio. Euro abgebaut. Gut so!\nAnalyst: Was nun?") == ["Wir haben 150 Mio. Euro abgebaut.", "Gut so!", "Was nun?"]
    assert L.sentences("") == []
