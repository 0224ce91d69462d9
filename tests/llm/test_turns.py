import pytest

from quarterloom.llm import turns as T

PEOPLE = [("Björn Ardvenmont", "Chief Executive Officer"), ("Célia Torneth", "Chief Financial Officer"), ("Inés Josphiex", "Analyst"), ("Yusuf Ostlaück", "Head of Investor Relations")]
D = T.Directory(PEOPLE)


def parsed(text):
    found = T.heads(text)
    return T.assemble(D, [a for a, _ in found], [T.clean(b) for _, b in found])


@pytest.mark.parametrize(
    ("label", "name"),
    [
        ("Björn Ardvenmont", "Björn Ardvenmont"), ("BJÖRN ARDVENMONT", "Björn Ardvenmont"), ("Bjorn Ardvenmont", "Björn Ardvenmont"), ("Ardvenmont", "Björn Ardvenmont"), ("B. Ardvenmont", "Björn Ardvenmont"),
        ("Ardvenmont, Björn", "Björn Ardvenmont"), ("Björn  Ardvenmont", "Björn Ardvenmont"), ("Björn Ardevnmont", "Björn Ardvenmont"), ("Bj?rn Ardvenmont", "Björn Ardvenmont"), ("Bj�rn Ardvenmnot", "Björn Ardvenmont"),
        ("Chief Financial Officer", "Célia Torneth"), ("CFO", "Célia Torneth"), ("Célia Torneth, Chief Financial Officer", "Célia Torneth"), ("Célia Torneth (Chief Financial Officer)", "Célia Torneth"),
        ("Inés Josphiex -- Some Bank -- Analyst", "Inés Josphiex"), ("Analyst Josphiex", "Inés Josphiex"), ("Operator ", "Operator"), ("Conference Operator", "Operator"), ("UNIDENTIFIED ANALYST", "Unidentified Analyst"), ("Duration", None), ("Two things", None),
    ],
)
def test_labels(label, name):
    assert D.name(label) == name


WANTED = [("Operator", "Good day."), ("Björn Ardvenmont", "Thanks. We grew."), ("Inés Josphiex", "Is it likely to last?"), ("Célia Torneth", "Yes.")]
LAYOUTS = {
    "lines": "Operator: Good day.\nBjörn Ardvenmont: Thanks.\nBjörn Ardvenmont: We grew.\nInés Josphiex: Is it likely to last?\nCélia Torneth: Yes.",
    "stamps": "[00:00:01] Operator: Good day.\n(00:00:02) Ardvenmont: Thanks.\n00:00:03 Björn Ardvenmont: We grew.\n[00:00:04] Inés Josphiex: Is it likely to last?\n00:00:09 CFO: Yes.",
    "voice": "WEBVTT\n\n00:00:29.246 --> 00:00:38.290\n<v Operator>Good day.\n\n00:00:40.000 --> 00:00:42.000\n<v Björn Ardvenmont>Thanks.\n\n00:00:43.000 --> 00:00:44.000\n<v björn ardvenmont>We grew.\n\n00:00:45.000 --> 00:00:46.000\n<v Josphiex, Inés>Is it likely to last?\n\n00:00:47.000 --> 00:00:48.000\n<v Célia Torneth, Chief Financial Officer>Yes.",
    "sides": "operator: Good day.\n<A - Björn Ardvenmont>: Thanks.\n<A - Björn Ardvenmont>: We grew.\n<Q - Inés Josphiex>: Is it likely to last?\n<A - Célia Torneth>: Yes.",
    "arrows": ">> Operator: Good day.\n>> Björn Ardvenmont: Thanks.\n>> Björn Ardvenmont: We grew.\n>> Inés Josphiex: Is it likely to last?\n>> Célia Torneth: Yes.",
    "bold": "**Operator** (00:00:01): Good day.\n\n**Björn Ardvenmont** (00:00:03): Thanks.\n\n**Björn Ardvenmont** (00:00:04): We grew.\n\n**Inés Josphiex** (00:00:05): Is it likely to last?\n\n**Célia Torneth** (00:00:06): Yes.",
    "blocks": "Prepared Remarks:\n\nOperator\n\nGood day.\n\nBjörn Ardvenmont -- Chief Executive Officer\n\nThanks.\n\nBJÖRN ARDVENMONT -- Chief Executive Officer\n\nWe grew.\n\nQuestions and Answers:\n\nInés Josphiex -- Bank -- Analyst\n\nIs it likely to last?\n\nCélia Torneth -- Chief Financial Officer\n\nYes.\n\nCall participants:\n\nBjörn Ardvenmont -- Chief Executive Officer",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert parsed(LAYOUTS[layout]) == WANTED


def test_running_text():
    filler = "We grew a little. " * 50
    text = f"Operator: Good day. Björn Ardvenmont: {filler}Inés Josphiex: Will it last? Célia Torneth: Yes. um Björn Ardvenmont: One thing: it works."
    assert [n for n, _ in parsed(text)] == ["Operator", "Björn Ardvenmont", "Inés Josphiex", "Célia Torneth", "Björn Ardvenmont"]


def test_running_text_cut_early():
    text = "Operator: Good day. Björn Ardvenmont: Thanks. We grew. Inés Josphiex: Is it likely to last? Célia Torneth: Yes."
    assert parsed(text) == WANTED
    assert parsed(text[:59]) == [WANTED[0], ("Björn Ardvenmont", "Thanks. We grew. Inés")]
    assert parsed(text + "\n\nDuration: 20 minutes") == WANTED
    # Colons in the speech of lines of one turn each.
    lines = "Operator: Two things: one.\nInés Josphiex: As he said: why?"
    assert parsed(lines) == [("Operator", "Two things: one."), ("Inés Josphiex", "As he said: why?")]
    assert parsed("00:00:01 Operator: Two things: one.") == [("Operator", "Two things: one.")]


def test_stamps_give_the_order():
    lines = "[00:00:01] Operator: Good day.\n(00:00:30) Inés Josphiex: Will it last?\n[00:00:20] Operator: A question.\n(00:00:40) Célia Torneth: Yes.\nUnstamped: word"
    assert [n for n, _ in parsed(lines)] == ["Operator", "Inés Josphiex", "Célia Torneth"]
    assert parsed(lines)[0][1] == "Good day. A question."
    voice = "WEBVTT\n\n00:00:09.000 --> 00:00:12.000\n<v Operator>One.\n\n00:04:08.362 --> 00:04:16.508\n<v Inés Josphiex>Why?\n\n00:04:02.911 --> 00:04:07.120\n<v Björn Ardvenmont>Next."
    assert [n for n, _ in parsed(voice)] == ["Operator", "Björn Ardvenmont", "Inés Josphiex"]
    bold = "**Operator** (00:00:01): One.\n\n**Inés Josphiex** (00:03:40): Why?\n\n**Célia Torneth** (00:03:20): Two."
    once = [n for n, _ in parsed(bold)]
    assert once == ["Operator", "Célia Torneth", "Inés Josphiex"]
    # A text that is there twice isn't mixed up.
    assert [n for n, _ in parsed(bold + "\n\n" + bold)] == once + once


def test_noise():
    text = "[Music]\nOperator: Good [crosstalk] day - um - and er, welcome.\nInés Josphiex: (laughter)\nCélia Torneth: Um, uh... [inaudible (twice)]\nOperator: Next.\nBjörn Ardvenmont: Thanks.\n\nDuration: 20 minutes"
    assert parsed(text) == [("Operator", "Good day and welcome. Next."), ("Björn Ardvenmont", "Thanks.")]
    assert parsed("") == [] and parsed("just words without any label") == []
    assert not T.has_words("♪ ♪ [a (b) c] -- 00:01:02 hmm") and T.has_words("um, yes")


def test_frames(spark):
    schema = "recent_id bigint, ticker string, transcript string, speaker string"
    rows = spark.createDataFrame([(1, "T", LAYOUTS["lines"], "x"), (2, "T", None, None), (3, "T", "", None), (4, None, "Operator: Hi.", None), (5, "N", "Operator: Hi.\nJane: Yes.", None), (1, "T", LAYOUTS["lines"], "x"), (6, "T", LAYOUTS["lines"].encode().decode("cp1252", "replace"), "x")], schema)
    people = spark.createDataFrame([("T", a, b) for a, b in PEOPLE + PEOPLE[:1]] + [("T", None, None)], "ticker string, speaker string, title string")
    got = T.speaker_turns(rows, people).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.recent_id, r.turn_no)):
        by.setdefault(r.recent_id, []).append((r.speaker, r.text))
    assert by[1] == [t for t in WANTED for _ in (0, 1)]
    assert by[4] == [("Operator", "Hi.")] and by[5] == [("Operator", "Hi. Jane: Yes.")] and [n for n, _ in by[6]] == [n for n, _ in WANTED]
    # Beyond the bound the directory is joined: the same turns.
    assert sorted(map(tuple, T.speaker_turns(rows, people, sent=0).collect())) == sorted(map(tuple, got))
    assert T.speaker_turns(rows.limit(0), people).count() == 0 and T.speaker_turns(rows, people.limit(0)).count() > 0


def test_annotations_of_any_depth_and_length():
    assert T.clean("We [a [b [c [d [e [f [g]]]]]]] grew") == "We grew"
    assert T.clean("We (" + "applause and more " * 50 + ") grew <" + "x" * 300 + "> by *" + "cheers " * 30 + "* ten") == "We grew by ten"
    # Brackets that nothing closes in their line are text.
    assert T.clean("We (grew] a lot\nand so on) here") == "We (grew] a lot and so on) here"
    assert T.clean("[" * 50_000) == "[" * 50_000 and T.clean("[" * 50_000 + "]" * 50_000) == ""


def test_fillers_alone_are_no_turn():
    assert parsed("Operator: Good day.\nInés Josphiex: You know...\nCélia Torneth: uh like...\nOperator: Next.") == [("Operator", "Good day. Next.")]


def test_the_tree():
    tree = T.parse("Prepared Remarks:\n[00:00:09] Operator: Hi (all).\n00:00:03 CFO: Yes.")
    assert [(n.rule, n.label, n.at) for n in tree.parts] == [("aside", None, None), ("aside", None, None), ("turn", "Operator", 9.0), ("turn", "CFO", 3.0)]
    assert [n.label for n in T.ordered(tree)] == [None, None, "CFO", "Operator"]


def test_long_labels():
    title = "Senior Vice President of Global Treasury, Investor Relations and Strategic Planning"
    assert parsed(f"Operator: Good day.\nBjörn Ardvenmont ({title}): Thanks.") == [("Operator", "Good day."), ("Björn Ardvenmont", "Thanks.")]
    assert parsed(f"Operator\n\nGood day.\n\nBjörn Ardvenmont -- {title} -- A Company With a Long Name\n\nThanks.") == [("Operator", "Good day."), ("Björn Ardvenmont", "Thanks.")]
